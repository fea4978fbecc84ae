"""Byte-level BPE encoding and decoding by traversal of a prefix-sharing trie.

The encoding of a string by BPE has this property: the encoding of each of its prefixes ends in exactly one token, and
what stands before that token is the encoding of the shorter prefix. So a trie node (a prefix) needs one state, its last
token: the token t that ends there such that t may follow the last token of the node len(t) higher up. Two tokens may
follow each other if, merged from bytes on, no merge crosses the border between them before they are complete.

Distinct words of a batch are walked in sorted order, which is the trie's depth-first order; the stack of states of the
current path is kept, so a prefix that many words share is encoded once. Encodings are kept from batch to batch in a
store of bounded size. Words are cut from texts by the tokenizer's own pre-tokenizer; a text whose only white space is
single blanks and line ends between other characters is split there first, as no word crosses such a border.

The tokenizer's definition (a JSON file of the tokenizers library; byte-level BPE without normaliser or prefix space) is
read on the driver and sent along. Added tokens in a text are tokens of their own, as the library has it.

Null texts count as empty (no ids). Whole texts are encoded. Repeated rows are encoded each; a table without rows gives
none. Columns other than doc_id and text are ignored (:func:`encoded` passes them through).
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, trimmed

#: Words whose encodings a worker keeps (some 150 bytes each), and pairs of tokens; over it a store starts anew.
STORE = 1_000_000
PAIRS = 500_000
#: Characters whose words are encoded together.
CHUNK = 4_000_000
#: Pieces that the library encodes as lines of one text.
LINES = 200
#: A lean worker's share of both, for tasks that share executors with other operators' workers.
LEAN = 5


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(rest)) for b in range(256)]


#: The pattern by which byte-level pre-tokenizers cut words (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN)


class Trie:
    """Encodes words, written in byte letters, to token ids."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]) -> None:
        self.vocab = vocab
        self.length = {i: len(t) for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(z, (x, y, r))
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # The automaton of all tokens: a state is the longest end of the path that begins a token.
        self.nodes = {"": 0}
        for token in vocab:
            for n in range(1, len(token) + 1):
                self.nodes.setdefault(token[:n], len(self.nodes))
        self.names = list(self.nodes)
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.names)
        self.steps: dict[tuple[int, str], int] = {}

    def _step(self, state: int, letter: str) -> int:
        """The state after a letter. The tokens that end there are found once, longest first."""
        name = self.names[state] + letter
        while name not in self.nodes:
            name = name[1:]
        nxt = self.steps[state, letter] = self.nodes[name]
        if self.ends[nxt] is None:
            at = ((self.vocab.get(name[i:]), len(name) - i) for i in range(len(name)))
            self.ends[nxt] = tuple((t, n) for t, n in at if t is not None and self.is_whole(t))
        return nxt

    def _edge(self, t: int, side: int, store: dict[int, list[tuple[int, float]]]) -> list[tuple[int, float]]:
        """The tokens at one edge of t while it is merged, first byte letter first, each with the rank at which it is merged into the next."""
        if (out := store.get(t)) is None:
            out, at, end = [], t, float("inf")
            while True:
                out.append((at, end))
                if at not in self.parts:
                    break
                p = self.parts[at]
                at, end = p[side], p[2]
            store[t] = out = out[::-1]
        return out

    def may_follow(self, s: int, t: int) -> bool:
        """No merge crosses the border between s and t."""
        if (known := self.pairs.get(s << 32 | t)) is not None:
            return known
        left, right = self._edge(s, 1, self.right), self._edge(t, 0, self.left)
        i = j = 0
        ok = True
        while True:
            (a, end_a), (b, end_b) = left[i], right[j]
            r = self.rank.get((a, b))
            if r is not None and r < end_a and r <= end_b:  # of equal ranks the left one is merged first
                ok = False
                break
            if end_a == end_b == float("inf"):
                break
            if end_a <= end_b:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[s << 32 | t] = ok
        return ok

    def is_whole(self, t: int) -> bool:
        """t's own letters are merged to t, and not to other tokens."""
        if (known := self.whole.get(t)) is None:
            known = True
            if t in self.parts:
                x, y, _ = self.parts[t]
                known = self.is_whole(x) and self.is_whole(y) and self._follows_but_for(x, y)
            elif self.length[t] > 1:
                known = False
            self.whole[t] = known
        return known

    def _follows_but_for(self, x: int, y: int) -> bool:
        """No merge crosses the border of x and y before both are complete."""
        left, right = self._edge(x, 1, self.right), self._edge(y, 0, self.left)
        i = j = 0
        while True:
            (a, end_a), (b, end_b) = left[i], right[j]
            if end_a == end_b == float("inf"):
                return True
            r = self.rank.get((a, b))
            if r is not None and r < end_a and r <= end_b:
                return False
            if end_a <= end_b:
                i += 1
            else:
                j += 1

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each distinct word. Letters outside the vocabulary give no id, as in the library without an unknown token."""
        out: dict[str, tuple[int, ...]] = {}
        last, states, before = [-1], [0], ""  # last[d], states[d]: of the path's first d letters
        follow, known, step, found = self.may_follow, self.pairs, self.steps, self.ends
        for w in sorted(words):
            d, n = 0, min(len(before), len(w))
            while d < n and w[d] == before[d]:
                d += 1
            del last[d + 1 :], states[d + 1 :]
            state = states[d]
            for end, letter in enumerate(w[d:], d + 1):
                if (nxt := step.get((state, letter))) is None:
                    nxt = self._step(state, letter)
                state = nxt
                for t, length in found[state]:
                    if length == end:
                        break
                    if (s := last[end - length]) >= 0:
                        if (ok := known.get(s << 32 | t)) is None:
                            ok = follow(s, t)
                        if ok:
                            break
                else:
                    raise ValueError(f"no encoding ends in the byte letter {letter!r}")
                last.append(t)
                states.append(state)
            ids, at = [], len(w)
            while at:
                ids.append(t := last[at])
                at -= self.length[t]
            out[w] = tuple(ids[::-1])
            before = w
        return out


class Codec:
    """Encodes and decodes texts by a tokenizer's definition. ``engine``: "trie", or "library" for the words that are not
    in the store; ``lean`` keeps fewer."""

    def __init__(self, definition: str, engine: str = "trie", lean: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        d = json.loads(definition)
        if engine == "library":
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            self.tokenizer = Tokenizer.from_str(definition)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        if d["model"]["type"] != "BPE" or d.get("normalizer") or (d.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or d["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normaliser and prefix space is needed")
        self.cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=d["pre_tokenizer"].get("use_regex", True)).pre_tokenize_str
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        self.trie = Trie(d["model"]["vocab"], merges) if engine == "trie" else None
        self.letters = byte_letters()
        self.letters_of = dict(enumerate(self.letters))
        byte = {c: i for i, c in enumerate(self.letters)}
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = max([*d["model"]["vocab"].values(), *self.added.values()]) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.bytes: list[bytes] = [b""] * size
        for t, i in d["model"]["vocab"].items():
            self.bytes[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        for t, i in self.added.items():
            self.bytes[i] = t.encode()
        self.names = [str(i) for i in range(size)]
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.line_end = d["model"]["vocab"].get(self.letters[10], -1)
        self.kind, self.share = f"<u{self.width}", LEAN if lean else 1
        self.store: dict[str, bytes | bool] = {}  # raw ids by piece

    def _raw(self, ids: Sequence[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def _words(self, text: str) -> list[str]:
        """The pre-tokenizer's words, in byte letters."""
        if max(text) < "\u0250":  # Latin, where all editions of Unicode agree on what is a letter
            return [w.encode().decode("latin-1").translate(self.letters_of) for w in _WORDS.findall(text)]
        return [w for w, _ in self.cut(text)]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Puts the encodings of pieces into the store; False for a piece with white space at an end."""
        keys, texts = [], []
        for p in pieces:
            # "\nword" follows a line end, "\0word" starts a text, and any other piece follows a blank
            own = p[:1] in "\n\0"
            body = p[1:] if own else p
            if not body or body[0].isspace() or body[-1].isspace():
                self.store[p] = False
            else:
                keys.append(p)
                texts.append(body if own else " " + p)
        line = self._raw([self.line_end])
        self.store.update((p, line + r if p[0] == "\n" else r) for p, r in zip(keys, self._by_trie(texts) if self.trie else self._by_library(texts)))

    def _by_trie(self, texts: list[str]) -> list[bytes]:
        words = list(map(self._words, texts))
        ids = {w: self._raw(v) for w, v in self.trie.encode(set(chain.from_iterable(words))).items()}
        return [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in words]

    def _by_library(self, texts: list[str]) -> list[bytes]:
        """The library's encodings of texts without line ends and without white space at their ends, but for a leading blank.
        They go in lines of longer texts, as no token crosses a line end before them."""
        out: list[bytes] = []
        parts = [texts[s : s + LINES] for s in range(0, len(texts), LINES)]
        for s in range(0, len(parts), 50):
            for part, e in zip(parts[s : s + 50], self.tokenizer.encode_batch_fast(["\n".join(p) for p in parts[s : s + 50]], add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                ends = np.flatnonzero(ids == self.line_end)
                if len(ends) != len(part) - 1:
                    raise ValueError("the tokenizer joins line ends with other text")
                data, at = ids.tobytes(), 0
                for end in (ends * self.width).tolist():
                    out.append(data[at:end])
                    at = end + self.width
                out.append(data[at:])
        return out

    def _slow(self, text: str) -> np.ndarray:
        if not self.trie:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        out: list[int] = []
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                out.append(self.added[part])
            elif part:
                words = self._words(part)
                ids = self.trie.encode(set(words))
                out.extend(chain.from_iterable(ids[w] for w in words))
        return np.array(out, self.kind)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        chunk: list[str] = []
        size = 0
        for t in texts:
            chunk.append(t or "")
            size += len(chunk[-1])
            if size > CHUNK // self.share:
                yield from self._encoded(chunk)
                chunk, size = [], 0
        yield from self._encoded(chunk)

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [bool(t) and "\0" not in t and not (self.split and self.split.search(t)) for t in texts]  # NUL marks the first piece of a text
        if any(plain):
            cut = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n") for t, ok in zip(texts, plain) if ok], pa.large_string()), " ")
            words = cut.values.dictionary_encode()
            distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
            raw = list(map(self.store.get, distinct))
            new = [i for i, r in enumerate(raw) if r is None]
            if len(self.store) + len(new) > STORE // self.share:
                self.store.clear()
            self._learn([distinct[i] for i in new])
            for i in new:
                raw[i] = self.store[distinct[i]]
            odd = np.array([r is False for r in raw])  # white space that only the pre-tokenizer can split
            flat = np.frombuffer(b"".join(r or b"" for r in raw), self.kind)
            sizes = np.array([len(r) if r else 0 for r in raw]) // self.width
            first = (np.cumsum(sizes) - sizes)[at]
            sizes = sizes[at]
            upto = np.cumsum(sizes)
            ids = flat[np.repeat(first - upto + sizes, sizes) + np.arange(upto[-1])]
            begins = cut.offsets.to_numpy()[:-1]
            slow = np.logical_or.reduceat(odd[at], begins).tolist()
            ends = np.append(upto[begins[1:] - 1], upto[-1]).tolist()
            starts = [0, *ends[:-1]]
        k = 0
        for t, ok in zip(texts, plain):
            if ok:
                yield self._slow(t) if slow[k] else ids[starts[k] : ends[k]]
                k += 1
            else:
                yield self._slow(t) if t else np.empty(0, self.kind)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The decoded text in UTF-8; bytes that are none become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").encode()


@lru_cache(4)
def codec(definition: str, engine: str = "trie", lean: bool = False) -> Codec:
    """One per worker, kept from task to task. Its stores hold millions of tuples and no cycles, so the worker's collector,
    which would walk them again and again, is switched off."""
    gc.disable()
    return Codec(definition, engine, lean)


def release() -> None:
    """Gives a worker's codecs back: other operators' tasks follow in the same process."""
    codec.cache_clear()
    gc.enable()
    gc.collect()
    trimmed()


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _digests(text: str, fill: Callable[[Codec, np.ndarray], tuple]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(text)
        for b in batches:
            rows = [fill(c, ids) for ids in c.encode_batch(t.as_py() for t in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _digest(c: Codec, raw: np.ndarray) -> tuple[int, str, str]:
    ids = raw.tolist()
    return len(ids), hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode_bytes(ids)).hexdigest()


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the text decoded from the
    ids): one row per document."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return in_arrow(src, _digests(definition(path), _digest), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, engine: str = "trie", decode: bool = False) -> DataFrame:
    """All columns of ``docs``, with ``ids`` (array of int) in place of a column of that name. With ``decode`` the text is
    given back as decoded from the ids (null texts: empty). A task keeps small stores and gives them back at its end."""
    text, cols = definition(path), [c for c in docs.columns if c != "ids"]
    at = cols.index("text")
    plain = docs.select(*[(F.col("text").cast("string") if i == at else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(text, engine, lean=True)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                p = b.slice(s, 500)
                raw = list(c.encode_batch(t.as_py() for t in p.column(at)))
                kept = [pa.array([c.decode_bytes(x.tolist()).decode() for x in raw], pa.string()) if decode and i == at else x for i, x in enumerate(p.columns)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([x.astype(np.int32) for x in raw], pa.list_(pa.int32()))], names=[*p.schema.names, "ids"])
        del c
        release()

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return in_arrow(plain, run, f"{ddl}, ids array<int>").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "ids")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """All columns of ``tokens``, with ``text``, decoded from ``ids`` (null: empty), in place of a column of that name. Ids
    that the tokenizer does not have fail."""
    definition_, cols = definition(path), [c for c in tokens.columns if c != "text"]
    at = cols.index("ids")
    plain = tokens.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(definition_, lean=True)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.decode_bytes(x.as_py() or []).decode() for x in b.column(at)], pa.string())], names=[*b.schema.names, "text"])
        del c
        release()

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return in_arrow(plain, run, f"{ddl}, text string").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)], "text")
