"""Token ids in binary shards with a minimal perfect hash index over document keys.

Documents are cut into ranges of ascending doc_id of about equal bytes of text, a shard each. A task encodes texts where
they are read, with the tokenizers library: distinct pieces between blanks once each, as no token crosses those borders.
Ids travel in two bytes each where the vocabulary fits, and a task per shard writes them in key order as they arrive,
keeping only the index in memory. Each attempt writes a file of its own name, and the manifest, a table that only
successful tasks contribute to, names the files that count; so a lost executor or a task run twice leaves an unused file
at worst.

A shard file, all numbers little-endian::

    magic "TOKSHRD2"
    ids    u16 or u32[tokens]
    pilots u32[buckets]        one per bucket of keys
    prints u32[keys]           by slot: a fingerprint of the key
    order  u32[keys]           by slot: the document's place in the shard
    ends   u64[docs]           by place: ids up to the document's end
    names  i64[docs]           by place: the key (0 for null)
    tail   magic | width u32 | docs u32 | null keys u32 | keys u32 | buckets u32 | tokens u64

A key is hashed to a bucket and, with the bucket's pilot, to a slot; slots are as many as distinct keys and each is used
once. A key that is not in the shard meets a foreign fingerprint but for one in four billion, and ``names`` then tells.

Null doc_ids come first and have no index entry. Repeated ids stand next to each other, and the index names the first. A
doc_id (or null) that fills more than a shard is dealt over several by a hash of the text; its documents are ordered by
that hash's part, then by their ids. Doc_ids are cast to long (one that is no number fails). Null texts hold the end id
only. Tables without rows give no shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, definition
from .common import block_of, block_starts, in_arrow, new_path, written

MAGIC, TAIL = b"TOKSHRD2", struct.Struct("<8sIIIIIQ")
#: Bytes of text a shard should hold, unless MOST_SHARDS would be too few; and ranges that are measured per shard.
SHARD_BYTES, MOST_SHARDS, RANGES = 64 << 20, 4096, 4
#: Keys a bucket should hold on average, and bytes of ids that are read at once.
BUCKET, PORTION = 4, 8 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _hash(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15))


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h ^ _mix(pilot.astype(_U) * _U(0xD1342543DE82EF95) + _U(1))) % _U(n)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pilots, slots) of distinct keys: the slots are a permutation of 0 .. n-1."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET))
    h = _hash(keys)
    of = (h % _U(buckets)).astype(np.int64)
    pilots, slots, used = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=buckets)
    begins = np.concatenate(([0], np.cumsum(counts)))
    for b in np.argsort(-counts, kind="stable"):
        if not counts[b]:
            break
        rows = order[begins[b] : begins[b + 1]]
        start, width = 0, 64
        while True:
            tries = np.arange(start, start + width, dtype=np.uint32)
            at = _slot(h[rows][None, :], tries[:, None], n).astype(np.int64)
            ok = ~used[at].any(axis=1)
            if len(rows) > 1:
                s = np.sort(at, axis=1)
                ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if ok.any():
                i = int(ok.argmax())
                pilots[b], slots[rows] = tries[i], at[i]
                used[at[i]] = True
                break
            start, width = start + width, min(width * 4, 1 << 16)
    return pilots, slots


def footer(names: np.ndarray, nulls: int, counts: np.ndarray, width: int) -> bytes:
    """What follows the ids of documents in order: their keys (the first ``nulls`` have none) and counts of ids."""
    real, first = np.unique(names[nulls:], return_index=True)
    pilots, slots = build_index(real) if len(real) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    prints, order = np.zeros(len(real), np.uint32), np.zeros(len(real), np.uint32)
    prints[slots] = (_hash(real) >> _U(32)).astype(np.uint32)
    order[slots] = first + nulls
    ends = np.cumsum(counts, dtype="<u8")
    tail = TAIL.pack(MAGIC, width, len(names), nulls, len(real), len(pilots), int(ends[-1]) if len(ends) else 0)
    return b"".join([pilots.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), order.astype("<u4").tobytes(), ends.tobytes(), names.astype("<i8").tobytes(), tail])


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A shard of documents in order; ids are raw, ``width`` bytes each."""
    names = np.array([0 if k is None else k for k in keys], np.int64)
    return b"".join([MAGIC, *ids, footer(names, sum(k is None for k in keys), np.array([len(x) // width for x in ids], np.int64), width)])


class Shard:
    """Keyed and ordered access to a shard: its index is held, its ids are read as asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        """``read`` gives so many bytes from a place in a shard of ``size`` bytes."""
        self._read = read
        tail = read(size - TAIL.size, TAIL.size) if size >= TAIL.size + len(MAGIC) else b""
        if tail[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        _, self.width, self.docs, self.nulls, n, buckets, self.tokens = TAIL.unpack(tail)
        at = len(MAGIC) + self.tokens * self.width
        index = read(at, size - TAIL.size - at)
        at = 0

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(index, kind, count, at)
            at += out.nbytes
            return out

        self.pilots, self.prints, self.order = part("<u4", buckets), part("<u4", n), part("<u4", n)
        self.ends, self.names = part("<u8", self.docs), part("<i8", self.docs)

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The shard's ids from one number to another."""
        return np.frombuffer(self._read(len(MAGIC) + begin * self.width, (end - begin) * self.width), f"<u{self.width}")

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the shard; -1 for keys that are not in it."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        h = _hash(keys)
        slot = _slot(h, self.pilots[(h % _U(len(self.pilots))).astype(np.int64)], len(self.prints)).astype(np.int64)
        place = self.order[slot].astype(np.int64)
        return np.where((self.prints[slot] == (h >> _U(32)).astype(np.uint32)) & (self.names[place] == keys), place, -1)

    def at(self, place: int) -> np.ndarray:
        """The ids of the document at a place."""
        return self.ids(int(self.ends[place - 1]) if place else 0, int(self.ends[place]))

    def get(self, key: int) -> np.ndarray | None:
        place = int(self.places(np.array([key], np.int64))[0])
        return None if place < 0 else self.at(place)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def read_shard(path: str) -> Shard:
    system, at = _open(path)
    f = system.open_input_file(at)

    def read(place: int, n: int) -> bytes:
        f.seek(place)
        return f.read(n)

    return Shard(read, f.size())


def _encoder(text: str, width: int) -> Callable[[Iterable[str]], Iterator[bytes]]:
    """Raw ids of texts, by the tokenizers library."""
    try:
        c = codec(text, "library")
    except ValueError:  # not a byte-level BPE: text by text
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)
        t.no_truncation()
        t.no_padding()
        return lambda texts: (np.array(t.encode(x, add_special_tokens=False).ids, f"<u{width}").tobytes() for x in texts)
    return lambda texts: (x.astype(f"<u{width}", copy=False).tobytes() for x in c.encode_batch(texts))


def _encode(text: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(text, width)
        end = np.array([end_id] if end_id is not None else [], f"<u{width}").tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x + end for x in encode(t.as_py() or "" for t in b.column(2))], pa.binary())], names=["shard", "doc_id", "ids"])

    return run


def _writer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(folder)
        system.create_dir(at, recursive=True)
        now, out = None, None
        name, names, counts, nulls = "", [], [], 0

        def done() -> pa.RecordBatch:
            n = np.concatenate(counts)
            out.write(footer(np.concatenate(names), nulls, n, width))
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "path", "docs", "tokens"])

        for b in batches:
            shards = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else []
            for s, e in zip(cuts, cuts[1:]):
                part = b.slice(s, e - s)
                if int(shards[s]) != now:
                    if out:
                        yield done()
                    now, name = int(shards[s]), f"shard-{int(shards[s]):06d}-{uuid.uuid4().hex}.tok"
                    out, names, counts, nulls = system.open_output_stream(f"{at}/{name}"), [], [], 0
                    out.write(MAGIC)
                nulls += part.column(1).null_count
                names.append(part.column(1).fill_null(0).to_numpy(zero_copy_only=False))
                counts.append(pc.binary_length(part.column(2)).to_numpy().astype(np.int64) // width)
                for x in part.column(2):
                    out.write(x.as_buffer())
        if out:
            yield done()

    return run


def dealt(docs: DataFrame) -> tuple[Column, int]:
    """The shard of a row with ``doc_id`` (long) and ``text``, and how many shards there are; none without rows.

    Ranges of doc_id, more than there will be shards, are measured in bytes; neighbours are put together up to a shard's
    worth, and one key that is more than that is cut by a hash of the text."""
    total = docs.agg(F.count("*").alias("n"), F.sum(_bytes()).alias("bytes")).first()
    if not total["n"]:
        return F.lit(0), 0
    least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["n"] // 200))
    wanted = max(1, min(MOST_SHARDS, max(least, -(-total["bytes"] // SHARD_BYTES))))
    worth = -(-total["bytes"] // wanted)
    starts = block_starts(docs.select("doc_id"), "doc_id", RANGES * wanted, alone=True)
    block = F.when(F.col("doc_id").isNull(), -1).otherwise(block_of(F.col("doc_id"), starts))
    sizes = docs.groupBy(block.alias("block")).agg(F.sum(_bytes()).alias("bytes"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("block").collect()  # a row per range
    first, parts = {}, {}
    shard, held = 0, 0
    for r in sizes:
        pieces = -(-r["bytes"] // worth) if r["lo"] == r["hi"] and r["bytes"] > 2 * worth else 1
        if held and (pieces > 1 or held + r["bytes"] > worth * 5 // 4):
            shard, held = shard + 1, 0
        first[r["block"]], parts[r["block"]] = shard, pieces
        if pieces > 1:
            shard += pieces
        else:
            held += r["bytes"]
    numbers = F.array(*[F.lit(first.get(b, 0)) for b in range(-1, len(starts))])
    pieces = F.array(*[F.lit(parts.get(b, 1)) for b in range(-1, len(starts))])
    at = (block + 2).cast("int")
    part = F.element_at(pieces, at)
    cut = F.when(part > 1, F.pmod(F.xxhash64("text"), part)).otherwise(0)
    return (F.element_at(numbers, at) + cut).cast("int"), shard + (held > 0 or not first)


def _bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None) -> DataFrame:
    """Encodes all texts and writes them to ``folder``, a URI that pyarrow's file systems reach from every executor.
    Returns the manifest: shard, path, docs, tokens and start (ids in the shards before)."""
    text = definition(tokenizer)
    d = json.loads(text)
    width = 2 if max([end_id or 0, *d["model"]["vocab"].values(), *(t["id"] for t in d["added_tokens"])]) < 1 << 16 else 4
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shard, shards = dealt(src)
    ids = in_arrow(src.select(shard.alias("shard"), "doc_id", "text"), _encode(text, end_id, width), "shard int, doc_id long, ids binary")
    rows = ids.repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    made = written(in_arrow(rows, _writer(folder, width), "shard int, path string, docs long, tokens long"), "manifest")
    return made.withColumn("start", F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens"))  # a row per shard


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = read_shard(path)
            ends = s.ends.astype(np.int64)
            begins = np.concatenate(([0], ends[:-1]))
            names = s.names[s.nulls :]
            first = np.concatenate(([True], names[1:] != names[:-1])) if len(names) else np.zeros(0, bool)
            if (s.places(names[first]) != np.flatnonzero(first) + s.nulls).any():  # every key by the index
                raise ValueError(f"{path}: the index misses a key")
            at = 0
            while at < s.docs:
                to = max(at + 1, int(np.searchsorted(ends, begins[at] + PORTION // s.width, "right")))
                ids = memoryview(s.ids(int(begins[at]), int(ends[to - 1])).astype("<u4").tobytes())
                cuts = (np.concatenate((begins[at : at + 1], ends[at:to])) - begins[at]) * 4
                crcs = [zlib.crc32(ids[x:y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                keys = pa.array(s.names[at:to], pa.int64(), mask=np.arange(at, to) < s.nulls)
                yield pa.RecordBatch.from_arrays([keys, pa.array(begins[at:to] + start, pa.int64()), pa.array(ends[at:to] - begins[at:to], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                at = to


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: each key is looked up in its shard's index."""
    rows = manifest.select("path", "start", "shard")
    return rows.repartitionById(max(1, manifest.count()), "shard").select("path", "start").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Shards in the shared folder, read back."""
    return read_back(written(write_shards(docs, new_path(docs.sparkSession, "shards"), tokenizer, end_id), "manifest"))
