"""Quality rules whose thresholds come from mergeable quantile sketches of each language and source.

Per document, from its whole text (null: empty): n_words, word_chars (code points in words), n_symbols (of
``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words inside three-word
windows found twice or more, the first time included), n_lines (lines with a word), n_upper (A-Z), n_bangs (``!``).

A document fails the base rules with under ``LEAST_WORDS`` words, or with over half of its words in repeated windows.
Those that pass give measures in whole thousandths (hundredths of a character for the mean word length) and their three
sizes (words, lines, characters in words). A sketch counts values by bucket: a value under 512 is its own bucket, a larger
one is cut to its nine leading bits, so a quantile is off by a 256th at most. Sketches merge by adding counts: those of a
language and source, of a language, of all. A group takes its quantiles from its own sketch if that holds ``LEAST_GROUP``
documents, else its language's, else all.

A measure's upper threshold is ``q75 + REACH * (q75 - q50) + slack``. With an exponential tail through the group's median
and upper quartile, one document in a thousand lies beyond REACH = log2(500) spreads. The slack is the rate that the
measure's tolerated occurrences make in a short document of the group (one of its lower quartile of sizes), so a group in
which a measure is mostly 0 bears a first few. The mean word length has no slack but a lower threshold too, ``q25 - REACH *
(q50 - q25)``. Up to a quarter of a group may be bad without moving the quartiles into it. No threshold is fixed: all are
read from the sketches. Thresholds join back on language and source: by broadcast where they are few, else by a shuffle
that adaptive execution splits for a hot source.

Null languages and sources form groups of their own. Columns besides doc_id, text, lang and source are passed through by
:func:`filtered` and ignored by :func:`judged`; a table without rows gives none; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, small, written

LEAST_WORDS, MOST_REPEATED, LEAST_GROUP, REACH = 50, 50, 100, 9
#: measure: (numerator, denominator, factor, occurrences a short document may have, whether a lower threshold holds too)
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 4, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 30, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 2, False),
    "upper": ("n_upper", "word_chars", 1000, 5, False),
    "bangs": ("n_bangs", "n_words", 1000, 4, False),
    "word_length": ("word_chars", "n_words", 100, 0, True),
}
#: The denominators, whose lower quartiles say what a short document of a group is.
SIZES = ["n_words", "n_lines", "word_chars"]
#: Leading bits that a sketch keeps of a value, and the quartiles it is asked for.
BITS, QUARTERS = 9, (1, 2, 3)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
_UPPER = bytes(range(65, 91))


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(b"".join(words).decode())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if n else []
    repeated = 0
    if n > 2:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        k = len(ids)
        if k < 2_000_000:  # three numbers fit in 63 bits
            code = (w[:-2] * k + w[1:-1]) * k + w[2:]
        else:
            pairs = np.unique(w[:-2] * k + w[1:-1], return_inverse=True)[1]
            code = pairs * k + w[2:]
        order = np.argsort(code, kind="stable")
        c = code[order]
        same = np.zeros(len(c) + 1, bool)
        same[1:-1] = c[1:] == c[:-1]
        twice = order[same[:-1] | same[1:]]
        hit = np.zeros(n, bool)
        for i in range(3):
            hit[twice + i] = True
        repeated = int(hit.sum())
    return n, chars, len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, _UPPER)), raw.count(b"!")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("_text")
        rows = [text_stats(t.as_py()) for t in b.column(at)]
        kept = [i for i in range(b.num_columns) if i != at]
        cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS))]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *cols], names=[*(b.schema.names[i] for i in kept), *(f"_{s}" for s in STATS)])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _lang, _source and the STATS (prefixed ``_``) of every document, then base_failed."""
    src = docs.select("doc_id", F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), F.col("text").cast("string").alias("_text"))
    out = in_arrow(src, _run, _ddl(src.drop("_text")) + "".join(f", _{s} long" for s in STATS))
    return out.withColumn("base_failed", (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words")))


def _value(measure: str) -> Column:
    over, under, factor, _, _ = MEASURES[measure]
    return F.expr(f"{factor} * _{over} div greatest(_{under}, 1)")


def bucket(v: Column) -> Column:
    """The sketch's bucket: the value with all but its BITS leading bits cleared."""
    drop = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketches(stats: DataFrame) -> DataFrame:
    """(_lang, _source, measure, bucket, c) over documents that pass the base rules, of all measures and sizes. Counts
    combine before the shuffle."""
    values = {m: _value(m) for m in MEASURES} | {s: F.col(f"_{s}") for s in SIZES}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in values.items()])).alias("p")
    return stats.where("not base_failed").select("_lang", "_source", pairs).groupBy("_lang", "_source", "p.measure", "p.bucket").agg(F.count("*").alias("c"))


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    return cells.groupBy(*by, "measure", "bucket").agg(F.sum("c").alias("c"))


def quantiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """q1, q2 and q3 (the first buckets that reach so many quarters of the count) and n of each sketch."""
    w = Window.partitionBy(*by, "measure")
    seen = cells.select("*", F.sum("c").over(w.orderBy("bucket")).alias("upto"), F.sum("c").over(w).alias("n"))
    return seen.groupBy(*by, "measure").agg(F.max("n").alias("n"), *[F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bucket"))).alias(f"q{k}") for k in QUARTERS])


def thresholds(cells: DataFrame) -> DataFrame:
    """(_lang, _source, hi_<measure>..., lo_word_length) for every language and source that occurs among ``cells``."""
    levels = [["_lang", "_source"], ["_lang"], []]
    own, lang, all_ = (quantiles(cells if len(by) == 2 else merged(cells, by), by) for by in levels)
    same = F.col("o._lang").eqNullSafe(F.col("l._lang")) & (F.col("o.measure") == F.col("l.measure"))
    q = own.alias("o").join(lang.alias("l"), same, "left").join(all_.alias("g"), F.col("o.measure") == F.col("g.measure"), "left")
    pick = lambda c: F.when(F.col("o.n") >= LEAST_GROUP, F.col(f"o.{c}")).when(F.col("l.n") >= LEAST_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"g.{c}")).alias(c)
    q = q.select("o._lang", "o._source", "o.measure", *[pick(f"q{k}") for k in QUARTERS])
    wide = q.groupBy("_lang", "_source").agg(*[F.max(F.when(F.col("measure") == m, F.col(f"q{k}"))).alias(f"{m}_{k}") for m in [*MEASURES, *SIZES] for k in QUARTERS])
    upper = {m: F.expr(f"{m}_3 + {REACH} * ({m}_3 - {m}_2) + {factor * slack} div greatest({size}_1, 1)") for m, (_, size, factor, slack, _) in MEASURES.items()}
    lower = {m: F.expr(f"{m}_1 - {REACH} * ({m}_2 - {m}_1)") for m, x in MEASURES.items() if x[4]}
    return wide.select("_lang", "_source", *[v.alias(f"hi_{m}") for m, v in upper.items()], *[v.alias(f"lo_{m}") for m, v in lower.items()])


def _joined(stats: DataFrame, limits: DataFrame) -> DataFrame:
    limits = small(limits.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), *[c for c in limits.columns if c[:3] in ("hi_", "lo_")]))
    out = stats.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    ok = ~F.col("base_failed")
    for m, (_, _, _, _, lower) in MEASURES.items():
        ok = ok & F.coalesce(_value(m) <= F.col(f"hi_{m}"), F.lit(True))
        ok = ok & F.coalesce(_value(m) >= F.col(f"lo_{m}"), F.lit(True)) if lower else ok
    return out.withColumn("kept", ok)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept: one row per document."""
    stats = written(measured(docs), "stats")
    limits = written(thresholds(sketches(stats)), "limits")
    return _joined(stats, limits).select("doc_id", *[F.col(f"_{c}").alias(c) for c in STATS[:5]], "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. The texts are read twice and not shuffled while the
    thresholds fit a broadcast."""
    limits = written(thresholds(sketches(measured(docs))), "limits")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STATS)))], names=[*b.schema.names, *(f"_{s}" for s in STATS)])

    stats = in_arrow(plain, run, _ddl(plain) + "".join(f", _{s} long" for s in STATS))
    stats = stats.withColumn("base_failed", (F.col("_n_words") < LEAST_WORDS) | (100 * F.col("_n_repeat_words") > MOST_REPEATED * F.col("_n_words")))
    return _joined(stats, limits).where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


