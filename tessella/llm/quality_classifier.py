"""Quality scores by regularised quadratic discriminant analysis over transformed statistics of a text.

Each class has the mean and covariance of its labelled documents' features; the covariance is shrunk towards the pooled
one and that towards its diagonal, so classes in which a feature hardly varies stay regular. The score is the logistic
function of the difference of the two log densities (by Mahalanobis distances through the Cholesky factors' inverses,
made once per model) and the log odds of the classes, divided by a temperature, as features are not independent draws.

Learning is one aggregation: each task gives count, sum and sum of products per class. Labels other than 0 and 1 are left
out; of repeated labels of a document the largest counts. With one class or none to learn from, every score is the share
of label 1 (0.5 without labels). Null and empty texts have features and a score like others. Repeated rows are scored
each. Columns besides doc_id and text (doc_id and quality of labels) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checksum_bucket, in_arrow, small, written
from .quality_rules import text_stats

FEATURES = ("words", "word_length", "symbols", "repeats", "dup_lines", "upper", "bangs", "distinct", "digits", "stops", "pipes", "commas", "longest_run", "short_words")
#: Shrinkage of a class's covariance towards the pooled one, of that towards its diagonal; the logistic's divisor.
TO_POOLED, TO_DIAGONAL, TEMPERATURE = 0.2, 0.1, 4.0
THRESHOLD = 0.3
#: Words of usual text that a share is taken with, so that texts of a few words are not extremes.
PRIOR = 10


def features(text: str | None) -> list[float]:
    """FEATURES of one text: logarithms of counts, square roots of smoothed shares."""
    n, chars, symbols, dups, repeats, lines, upper, bangs = text_stats(text)
    raw = (text or "").encode()
    words = raw.split()
    w, c = max(n, 1), max(chars, 1)
    run = best = 0
    before = None
    for x in words:
        run = run + 1 if x == before else 1
        best = run if run > best else best
        before = x
    share = lambda a, b, usual=0.0: float(np.sqrt((a + PRIOR * usual) / (b + PRIOR)))
    return [
        float(np.log1p(n)), float(np.log1p(chars / w)), share(symbols, w), share(repeats, w), share(dups, max(lines, 1)), share(upper, c, 0.02), share(bangs, w),
        share(len(set(words)), w, 0.8), share(len(raw) - len(raw.translate(None, b"0123456789")), c), share(raw.count(b"."), w, 0.1), share(raw.count(b"|"), w),
        share(raw.count(b","), w, 0.05), float(np.log1p(best)), share(sum(1 for x in words if len(x) < 4), w, 0.4),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x: the features of every document."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return in_arrow(src, _features, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(FEATURES)
    sums = {0: np.zeros(1 + k + k * k), 1: np.zeros(1 + k + k * k)}
    for b in batches:
        if not b.num_rows:
            continue
        x = np.array(b.column(0).to_pylist())
        y = b.column(1).to_numpy(zero_copy_only=False)
        for c in sums:
            z = x[y == c]
            sums[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([sums[0].tolist(), sums[1].tolist()], pa.list_(pa.float64()))], names=["y", "m"])


@dataclass
class Model:
    """Two classes' means, inverse Cholesky factors and log determinants on standardised features; or a constant score."""

    share: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - half for mean, inverse, half in self.classes]
        d = (logs[1] - logs[0] + np.log(self.share / (1 - self.share))) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(d, -50, 50)))


def model_of(moments: dict[int, np.ndarray]) -> Model:
    k = len(FEATURES)
    n = {c: m[0] for c, m in moments.items()}
    total = sum(n.values())
    if total == 0 or min(n.get(0, 0), n.get(1, 0)) < 2:
        return Model(n.get(1, 0) / total if total else 0.5)
    mean = {c: m[1 : 1 + k] / n[c] for c, m in moments.items()}
    cov = {c: m[1 + k :].reshape(k, k) / n[c] - np.outer(mean[c], mean[c]) for c, m in moments.items()}
    centre = sum(n[c] * mean[c] for c in n) / total
    within = sum(n[c] * cov[c] for c in n) / total
    scale = np.sqrt(np.maximum(np.diag(within), 1e-6))
    pooled = within / np.outer(scale, scale)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.eye(k)
    classes = []
    for c in (0, 1):
        s = (1 - TO_POOLED) * cov[c] / np.outer(scale, scale) + TO_POOLED * pooled
        low = np.linalg.cholesky(s + 1e-9 * np.eye(k))
        classes.append(((mean[c] - centre) / scale, np.linalg.inv(low), float(np.log(np.diag(low)).sum())))
    return Model(n[1] / total, centre, scale, classes)


def fitted(measures: DataFrame, labels: DataFrame) -> Model:
    """The model from features (doc_id, x) and labels (doc_id, y)."""
    y = labels.where("y in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("y").cast("int")).alias("y"))
    rows = measures.join(small(written(y, "labels")), F.col("doc_id") == F.col("_id")).select("x", "y")
    parts = rows.mapInArrow(_moments, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v"))
    # rounded before they are added, so that the order in which tasks arrive does not matter
    sums = parts.groupBy("y", "i").agg(F.sum(F.round("v", 6).cast("decimal(38,6)")).cast("double").alias("v")).collect()  # two rows of a fixed length
    out = {0: np.zeros(1 + len(FEATURES) * (1 + len(FEATURES))), 1: np.zeros(1 + len(FEATURES) * (1 + len(FEATURES)))}
    for r in sums:
        out[r["y"]][r["i"]] = r["v"]
    return model_of(out)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.round(model.scores(np.array(b.column(1).to_pylist()).reshape(b.num_rows, len(FEATURES))), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def held_out(key: str = "doc_id"):
    """The documents whose labels are not learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(checksum_bucket(F.col(key), 5) == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, score, predicted: one row per document; learns from the labels that are not held out."""
    measures = written(measured(docs), "features")
    model = fitted(measures, labels.where(~held_out()).select("doc_id", F.col(label).alias("y")))
    return measures.mapInArrow(_score(model), f"doc_id {measures.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
