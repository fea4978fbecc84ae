import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import bpe, token_shards
from tessella.llm.common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, "\n", " a  b\t\n\nc ", "<|endoftext|>x <|endoftext|> y<|endoftext|>", "\u65e5\u672c\u8a9e \u306e \U0001f926\U0001f3fd e\u0301", "don't I'll 'tis 12345 a1b2 __init__ x\u00a0y \r\n z", "x" * 3000, "a\nb c\n",
    "na\u00efve fa\u00e7ade\u0085x", "ab\x00cd \x00x \x1cq", "\n a", "a \nb", "it's\n'quoted' $$$ ### http://x.y/z?a=b&c=d", "\u00b2 \u00bd\u00aa \u0130", " lead", "trail ", "\u2028x\u2003y", "x \0abc", "\0abc x", "a\0 \n\0b", "x\r y\x0b z",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(0)
    fuzz = ["".join(rng.choices("theand \n.,'0129\u00e9\u00df\u00c4$|", k=rng.randint(1, 40))) for _ in range(1500)]
    return TEXTS + fuzz + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("engine", ["trie", "library"])
def test_equals_library(library, texts, engine):
    c = bpe.Codec(bpe.definition(PATH), engine)
    for t, ids in zip(texts, c.encode_batch(texts), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert c.decode_bytes(want).decode() == library.decode(want, skip_special_tokens=False) == (t or "")


def test_broken_utf8_decodes_as_library(library):
    c = bpe.Codec(bpe.definition(PATH))
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert c.decode_bytes(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_shared_prefixes_are_walked_once(monkeypatch):
    c = bpe.Codec(bpe.definition(PATH))
    steps = []
    real = bpe.Trie._step
    monkeypatch.setattr(bpe.Trie, "_step", lambda self, s, x: steps.append(x) or real(self, s, x))
    c.trie.encode({"zqzqzqzqa", "zqzqzqzqb", "zqzqzqzqab"})
    assert len(steps) <= 12


def test_stores_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "STORE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    monkeypatch.setattr(bpe, "CHUNK", 100)
    c = bpe.Codec(bpe.definition(PATH))
    texts = [f"some words {i} and moreover {i * 7919} things" for i in range(200)]
    assert [x.tolist() for x in c.encode_batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(bpe.definition(public_tokenizers.path("word_bpe_49k.json")))


def test_shard_encoder_equals_library(library, texts):
    enc = token_shards._encoder(bpe.definition(PATH), 2)
    for t, ids in zip(texts, enc(x or "" for x in texts)):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    other = public_tokenizers.path("word_bpe_49k.json")
    assert np.frombuffer(next(iter(token_shards._encoder(bpe.definition(other), 4)(["hello world"]))), "<u4").tolist() == Tokenizer.from_file(other).encode("hello world", add_special_tokens=False).ids


def test_round_trip_query(spark, library):
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)] + [(0, "", 5), (None, "a b", 5)], "doc_id bigint, text string, ids int")
    out = bpe.round_trips(d, PATH).collect()
    assert len(out) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (by[i]["n_tokens"], by[i]["ids_sha256"], by[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    e = bpe.encoded(d, PATH)
    assert e.columns == ["doc_id", "text", "ids"] and e.where("doc_id = 7").first()["ids"] == library.encode(TEXTS[7]).ids
    assert bpe.round_trips(d.limit(0), PATH).count() == 0
    back = bpe.encoded(d, PATH, decode=True)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in back.collect() if r["doc_id"]) == sorted((False, i, t or "") for i, t in enumerate(TEXTS) if i)
    again = bpe.decoded(e.drop("text").withColumn("c0", F.lit(1)), PATH)
    assert again.columns == ["doc_id", "ids", "c0", "text"]
    assert {r["doc_id"]: r["text"] for r in again.collect() if r["doc_id"]} == {i: t or "" for i, t in enumerate(TEXTS) if i}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300, 5000])
def test_minimal_perfect_hash(n):
    rng = random.Random(n)
    keys = np.array(sorted({rng.randrange(-(2**62), 2**62) for _ in range(n)}), np.int64)
    rng.shuffle(keys)
    if n:
        _, slots = token_shards.build_index(keys)
        assert sorted(slots.tolist()) == list(range(n))
    ids = [np.arange(i % 7, dtype="<u2").tobytes() for i in range(n)]
    order = np.argsort(keys)
    s = token_shards.Shard.of(token_shards.pack([int(keys[i]) for i in order], [ids[i] for i in order], 2))
    for i in range(0, n, max(1, n // 50)):
        assert s.get(int(keys[i])).tobytes() == ids[i]
    assert s.get(2**62 + 5) is None
    with pytest.raises(ValueError):
        token_shards.Shard.of(b"x" * 100)


def test_shards_against_library(spark, sf, library):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"]: r for r in token_shards.written_and_read(d, PATH, 0).collect()}
    start = 0
    for r in d.orderBy("doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids + [0]
        o = out[r["doc_id"]]
        assert (o["start"], o["n_tokens"], o["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_of_odd_rows(spark):
    d = spark.createDataFrame([(5, "b", 1), (5, "b", 1), (None, "n", 2), (2, None, 3), (9, "x y " * 9000, 4)], "doc_id bigint, text string, shard int")
    m = token_shards.write_shards(d, new_path(spark, "t"), PATH, 0)
    rows = sorted((tuple(r) for r in token_shards.read_back(m).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 2, 5, 5, 9] and rows[1][2] == 1 and rows[-1][1] == sum(r[2] for r in rows[:-1])
    found = [x for r in m.collect() if (x := token_shards.read_shard(r["path"]).get(5)) is not None]
    assert len(found) == 1 and found[0].tolist()[-1] == 0
    assert all(token_shards.read_shard(r["path"]).get(77) is None for r in m.collect())
    assert token_shards.written_and_read(d.where(F.lit(False)), PATH, 0).count() == 0


def test_hot_keys_are_split(spark, library, monkeypatch):
    """A doc_id, and a missing one, that fill many shards: every shard is bounded, order and starts hold."""
    monkeypatch.setattr(token_shards, "SHARD_BYTES", 4000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    rows = [(rng.choice([7, None, i, i]), " ".join(word() for _ in range(rng.choice([5, 20, 60])))) for i in range(900)]
    m = token_shards.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), new_path(spark, "t"), PATH, 0)
    made = m.orderBy("shard").collect()
    assert len(made) > 30 and max(r["tokens"] for r in made) < 8 * sum(r["tokens"] for r in made) / len(made)
    out = sorted((tuple(r) for r in token_shards.read_back(m).collect()), key=lambda r: r[1])
    assert [r[0] for r in out] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in out] == np.concatenate(([0], np.cumsum([r[2] for r in out])[:-1])).tolist()
    crc = lambda t: zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted((str(i), c) for i, _, _, c in out) == sorted((str(i), crc(t)) for i, t in rows)
