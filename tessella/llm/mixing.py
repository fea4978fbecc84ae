"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target is its share of the words, by weight, cut at ``most`` times its size; what is cut goes to the other
sources by weight until none is above. Each document of a source is to be taken target / size times: the whole part
surely, the rest with a probability that is rounded to 0 or 1 dependently. Two documents with open probabilities p and q
and sizes s and t trade words, p*s + q*t staying equal, until one of them is 0 or 1; which of the two ways is drawn such
that neither's expectation changes. One document stays open and meets the next. So the words a source gives differ from
its target by less than one document, whatever the draws.

Documents meet in groups of some tens, dealt by a hash of the id (groups of groups above that), each folded in one task;
every group passes one open document to the next level, so a source with n documents needs about log(n) / log(32) levels
and no task sees a whole source. Groups are folded from their largest document down, so that what stays open is small. Draws are hashes of the ids that meet, so reruns agree.

Null texts have size 0. Documents without words are never taken. A null source is a source, last in order. Repeated ids
share a group. Tables without rows give none. Columns besides doc_id, text and source are ignored by :func:`mixed` and
passed through by :func:`repeated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, written

WEIGHTS, SHARE, MOST, GROUP = (5, 2, 1), 1.5, 2, 32
_OPEN = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of every document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, n, source_size, target: one row per source, found by a few aggregations over that table."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source, not per document
    per = written(per.select("*", F.element_at(w, (order % len(weights) + 1).cast("int")).alias("weight")).select("*", (F.col("source_size") * most).cast("double").alias("cap")), "sources")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:  # each round fixes the sources that are above their cap and shares the rest; the level only rises
        row = per.agg(F.sum(F.when(F.col("cap") <= F.col("weight") * level, F.col("cap"))).alias("fixed"), F.sum(F.when(F.col("cap") > F.col("weight") * level, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        rise = (total - (row["fixed"] or 0.0)) / row["open"]
        if rise <= level:
            break
        level = rise
    return per.select("source", "n", "source_size", F.least("cap", F.col("weight") * F.lit(float(level))).alias("target"))


def _draw(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(20_231), *cols), 11).cast("double") * F.lit(2.0**-53)


def _is_open(p: Column) -> Column:
    return (p > _OPEN) & (p < 1 - _OPEN)


def _fold(members: Column, level: int) -> Column:
    """Folds an array of (id, size, p) into (open: that which stays open, done: ids and results of the others)."""
    item = "struct<id:bigint,size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(f"array<{item}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        o = acc["open"]
        s, t, p, q = o["size"].cast("double"), x["size"].cast("double"), o["p"], x["p"]
        up = F.least((1 - p) * s, q * t)  # words that the open one can gain from x
        down = F.least(p * s, (1 - q) * t)
        gain = _draw(o["id"], x["id"], F.lit(level)) * (up + down) < down
        moved = F.when(gain, up).otherwise(-down)
        p2, q2 = p + moved / s, q - moved / t
        a = F.struct(o["id"].alias("id"), o["size"].alias("size"), p2.alias("p"))
        b = F.struct(x["id"].alias("id"), x["size"].alias("size"), q2.alias("p"))
        both = F.struct(F.when(_is_open(p2), a).otherwise(F.when(_is_open(q2), b).otherwise(F.lit(None).cast(item))).alias("open"), F.concat(acc["done"], F.when(_is_open(p2), F.array(b)).when(_is_open(q2), F.array(a)).otherwise(F.array(a, b))).alias("done"))
        fresh = F.when(_is_open(q), F.struct(x.alias("open"), acc["done"].alias("done"))).otherwise(F.struct(acc["open"].alias("open"), F.concat(acc["done"], F.array(x)).alias("done")))
        return F.when(o.isNull() | ~_is_open(q), fresh).otherwise(both)

    return F.aggregate(members, start, step)


def rounded(items: DataFrame) -> DataFrame:
    """(id, taken) of rows (source, id, size, p, n): p rounded to 0 or 1, the words of each source kept to within one
    document. n is the number of the source's rows."""
    left = items.select("source", "id", "size", "p", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP)).alias("group"), F.ceil(F.col("n") / GROUP).alias("groups"))
    done, level = None, 0
    while True:
        g = left.groupBy("source", "group", "groups").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "id", "size", "p"))).alias("m"))
        g = written(g.select("source", "group", "groups", _fold(F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["p"].alias("p"))), level).alias("f")), "folds")
        out = g.select(F.explode("f.done").alias("d")).select("d.id", "d.p")
        done = out if done is None else done.union(out)
        rest = g.where("f.open is not null").select("source", "f.open.id", "f.open.size", "f.open.p", F.col("group"), F.col("groups"))
        top = rest.agg(F.max("groups")).first()[0]
        if top is None:
            break
        if top <= 1:  # the one that stays open in each source is drawn alone
            done = done.union(rest.select("id", F.when(_draw(F.col("id"), F.lit(-1)) < F.col("p"), 1.0).otherwise(0.0).alias("p")))
            break
        left, level = rest.select("source", "id", "size", "p", F.floor(F.col("group") / GROUP).alias("group"), F.ceil(F.col("groups") / GROUP).alias("groups")), level + 1
    return done.select("id", F.when(F.col("p") > 0.5, 1).otherwise(0).alias("taken"))


def _copies(docs: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """doc_id, source, size, source_size, target, copies. A row's id inside is a hash of its id, size and source."""
    sized = written(sizes(docs), "sizes")
    t = small(targets(sized, share, most, weights).withColumnRenamed("source", "_s"))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_s"))).withColumn("x", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", "n", F.floor("x").alias("whole"), (F.col("x") - F.floor("x")).alias("p"), F.xxhash64("doc_id", "source", "size").alias("id"))
    open_ = rows.where((F.col("size") > 0) & _is_open(F.col("p"))).select("source", "id", "size", "p", "n")
    # Rows alike in id, source and size trade as one item.
    open_ = open_.groupBy("source", "id").agg(F.sum("size").alias("size"), F.first("p").alias("p"), F.first("n").alias("n"))
    up = rounded(open_).withColumnRenamed("id", "_id")
    nearly = F.when(F.col("p") >= 1 - _OPEN, 1).otherwise(0)
    return rows.join(up, F.col("id") == F.col("_id"), "left").withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.coalesce("taken", nearly)).otherwise(0).cast("long"))


def mixed(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), copies: a row per document."""
    c = _copies(docs, share, most, weights)
    return c.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeated(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, all columns unchanged."""
    c = written(_copies(docs, share, most, weights).select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), F.col("copies").cast("int").alias("_copies")).distinct(), "copies")
    # inputs go by number, so that no name of theirs meets one of ours
    d = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)])
    doc_id, text, source = (F.col(f"c{docs.columns.index(x)}") for x in ("doc_id", "text", "source"))
    d = d.withColumn("_n", F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    on = doc_id.eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & source.cast("string").eqNullSafe(F.col("_source"))
    out = d.join(small(c), on).withColumn("_k", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return out.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])
