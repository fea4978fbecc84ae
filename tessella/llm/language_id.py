"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point; so has the gap that
stands for any run of other characters. An n-gram's vector binds (multiplies) its letters' vectors, the i-th from its end
rotated by i places. A text's vector bundles (adds) the vectors of its n-grams of one to three characters, each order
scaled to the same total; a language's prototype bundles its texts. A document gets the language whose prototype has
the largest cosine with its vector; the score is that cosine, no less than 0. Texts are lower-cased.

Bundling is a sum, so prototypes come from one aggregation over the training texts: each task counts n-grams per language
and emits one vector per language. Ties go to the language first in code point order.

Null texts, and texts without a letter, get ``und`` and score 0. Rows with a null lang are predicted but not learnt from.
With nothing to learn from, all are ``und``. Whole texts are used, in pieces of bounded size. Extra columns are ignored
(:func:`filtered` passes them through); repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checksum_bucket, in_arrow

DIMENSIONS = 1024
ORDERS = (1, 2, 3)
#: n-gram vectors that a worker keeps, at 4 kB each; over it the store starts anew.
STORE = 20_000
#: Languages that prototypes may hold in the driver and every worker (4 kB each).
MOST_LANGUAGES = 10_000
PIECE = 1 << 18
GAP = 0x110000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(GAP)), bool, GAP)


@lru_cache(20_000)
def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([1729, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def ngram_vector(codes: tuple[int, ...]) -> np.ndarray:
    out = letter_vector(codes[-1])
    for i, c in enumerate(reversed(codes[:-1]), 1):
        out = out * np.roll(letter_vector(c), i)
    return out


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of a text's lower-cased letters, with a GAP for each run of other characters and at both ends; empty
    without a letter."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    codes[~is_letter] = GAP
    codes = np.concatenate(([GAP], codes, [GAP]))
    return codes[~((codes == GAP) & np.concatenate(([False], codes[:-1] == GAP)))]


def ngram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed as 21 bits a character above 0, and their weights: each order adds up to its share."""
    keys, weights = [], []
    x = codes + 1
    for n in ORDERS:
        k = len(x) - n + 1
        if k < 1:
            continue
        code = np.zeros(k, np.int64)
        for i in range(n):
            code = code << 21 | x[i : i + k]
        u, c = np.unique(code, return_counts=True)
        if n == 1:
            u, c = u[u != GAP + 1], c[u != GAP + 1]
        keys.append(u)
        weights.append(c / max(c.sum(), 1))
    return np.concatenate(keys), np.concatenate(weights)


class Store:
    """Vectors of n-grams, in one array with a sorted index; starts anew when full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.rows, self.used = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((1024, DIMENSIONS), np.float32), 0

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = i < len(self.keys)
        known[inside] = self.keys[i[inside]] == keys[inside]
        if not known.all():
            new = keys[~known]
            while self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            for j, k in enumerate(new.tolist(), self.used):
                codes = []
                while k:
                    codes.append((k & 0x1FFFFF) - 1)
                    k >>= 21
                self.rows[j] = ngram_vector(tuple(reversed(codes)))
            order = np.argsort(all_ := np.concatenate([self.keys, new]), kind="stable")
            self.keys, self.at = all_[order], np.concatenate([self.at, np.arange(self.used, self.used + len(new))])[order]
            self.used += len(new)
            i = np.searchsorted(self.keys, keys)
        return self.at[i]

    def bundle(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if self.used > STORE:
            self.clear()
        out = np.zeros(DIMENSIONS, np.float32)
        for s in range(0, len(keys), 16_384):
            at = self.rows_of(keys[s : s + 16_384])  # may move the rows
            out += weights[s : s + 16_384].astype(np.float32) @ self.rows[at]
        return out


def text_vector(text: str | None, store: Store) -> np.ndarray | None:
    """The text's bundle; None without a letter."""
    codes = letter_codes(text)
    return store.bundle(*ngram_counts(codes)) if len(codes) else None


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, sums = Store(), {}
    held: dict[str, list[np.ndarray]] = {}

    def add(lang: str) -> None:
        codes = np.concatenate(held.pop(lang))
        for s in range(0, len(codes), PIECE):
            keys, weights = ngram_counts(codes[s : s + PIECE])
            sums[lang] = sums.get(lang, 0) + store.bundle(keys, weights).astype(np.float64) * len(codes[s : s + PIECE])

    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            if len(codes := letter_codes(text.as_py())):
                lang = lang.as_py()
                held.setdefault(lang, []).append(codes)
                size[lang] = size.get(lang, 0) + len(codes)
                if size[lang] >= PIECE:
                    add(lang)
                    size[lang] = 0
    for lang in list(held):
        add(lang)
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "v"])


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A vector of length 1 for each non-null lang of ``docs`` (columns lang and text)."""
    parts = in_arrow(docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), _learn, "lang string, v array<double>")
    # Rounded before they are added, so that the order in which tasks arrive does not matter.
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round("x", 3).cast("decimal(30,3)")).cast("double").alias("x"))
    rows = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    out = {r["lang"]: np.array(r["v"]) for r in rows}
    return {k: v / n for k, v in sorted(out.items()) if (n := float(np.linalg.norm(v)))}


def _predict(model: dict[str, np.ndarray], at: int, keep: bool):
    names = sorted(model)
    matrix = np.stack([model[k] for k in names]).astype(np.float32) if names else np.empty((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store()
        for b in batches:
            langs, scores = [], []
            for text in b.column(at):
                v = text_vector(text.as_py(), store) if names else None
                if v is None or not (norm := float(np.linalg.norm(v))):
                    langs.append("und")
                    scores.append(0.0)
                else:
                    cos = matrix @ v / norm
                    best = int(cos.argmax())
                    langs.append(names[best])
                    scores.append(round(min(1.0, max(0.0, float(cos[best]))), 6))
            cols = [c for i, c in enumerate(b.columns) if keep or i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(n for i, n in enumerate(b.schema.names) if keep or i != at), "lang_pred", "score"])

    return run


def identified(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score: one row per document."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return in_arrow(src, _predict(model, 1, False), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """The documents that learning leaves out: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(checksum_bucket(F.col(key), 3) == 1, F.lit(False))


def filtered(docs: DataFrame, least: float) -> DataFrame:
    """The documents with a letter whose best cosine is ``least`` or more, all columns unchanged."""
    model = prototypes(docs.where(~held_out()))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    out = in_arrow(plain, _predict(model, docs.columns.index("text"), True), f"{ddl}, lang_pred string, score double")
    return out.where(f"lang_pred <> 'und' and score >= {least}").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


