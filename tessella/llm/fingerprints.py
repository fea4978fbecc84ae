"""Exact fingerprints of documents, with DataFrame functions only.

The canonical form of a text is its compatibility composition (NFKC) after Unicode case folding, with each run of white
space as one space and none at the ends. The fingerprint is 128 bits of xxhash64 under two seeds and the canonical
form's length in bytes, in hex. Inside each bucket of equal hashes the canonical bytes themselves are compared, those of edited
texts among them: the smallest and the largest text of a bucket are found (copies combine before the shuffle), and where
they differ, which only a collision of 128 bits brings about, the fingerprints of that bucket are extended by a SHA-256 of
the bytes. So equal canonical forms have equal fingerprints, and different ones different fingerprints.

Null texts count as empty. Repeated rows are fingerprinted each. Tables without rows give none. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, block_starts, small, written

_SEED = 0x5DEECE66D
#: Bytes of text that a range should hold, and the most ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 16_384


def canonical(text: Column) -> Column:
    """The canonical form. The two ICU methods run inside the executors' JVM."""
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    return F.trim(F.regexp_replace(compose(fold(compose(F.coalesce(text, F.lit(""))))), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """The 128-bit hash and the length, in hex."""
    part = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit(_SEED), canon)), F.lower(F.hex(F.octet_length(canon))))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(sha: Column) -> Column:
    return F.lower(F.hex(sha))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and mark, a hash by which a text is found again (of 53 bits, as quantiles are doubles)."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.shiftright(F.xxhash64("text"), 11))


def _hashed(texts: DataFrame) -> DataFrame:
    """``texts`` with hash and sha of the canonical form, which is found once."""
    canon = texts.withColumn("_canon", canonical(F.col("text")))
    return canon.withColumns({"hash": digest(F.col("_canon")), "sha": _sha(F.col("_canon"))}).drop("_canon")


def _unlike(bucket_texts: DataFrame) -> DataFrame:
    """(hash) of buckets whose canonical bytes differ, from (hash, text)."""
    canon = bucket_texts.select("hash", canonical(F.col("text")).alias("canon"))
    return written(canon.groupBy("hash").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("hash"), "collisions")


def collisions(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(hash) of buckets of equal hashes whose canonical bytes differ: none, but for a collision of 128 bits. ``rows``, a
    stored table, has hash and mark of the documents; if also edited_hash, edited_sha and next_mark, the edited texts are
    compared along. Only the texts of buckets with two texts and more are read again."""
    edited = "edited_hash" in rows.columns
    all_ = rows.select("hash").union(rows.select("edited_hash")) if edited else rows.select("hash")
    shared = written(all_.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1").select("hash"), "shared")
    plain = _texts(docs).select("mark", "text")
    own = written(rows.join(shared, "hash", "left_semi").select("mark", "hash").distinct(), "own")
    found = plain.join(small(own), "mark").select("hash", "text")  # a chance hit of a mark only adds a text to its bucket
    if edited:
        again = written(rows.join(shared.withColumnRenamed("hash", "edited_hash"), "edited_hash", "left_semi").select("mark", "next_mark", "edited_hash", "edited_sha").distinct(), "again")
        if not again.isEmpty():
            marks = again.select("mark").union(again.select(F.col("next_mark").alias("mark"))).distinct()
            pieces = plain.join(marks, "mark", "left_semi").distinct()
            both = again.join(pieces, "mark").join(pieces.select(F.col("mark").alias("next_mark"), F.col("text").alias("next_text")), "next_mark")
            made = both.withColumn("text", _edited(F.col("text"), F.col("next_text"))).where(_sha(F.col("text")) == F.col("edited_sha"))
            found = found.union(made.select(F.col("edited_hash").alias("hash"), "text"))
    return _unlike(found.join(shared, "hash", "left_semi"))


def _resolved(df: DataFrame, bad: DataFrame, hash_: str, sha: str, out: str) -> DataFrame:
    """``out``: the hash, extended by the SHA-256 if it is among the collisions."""
    b = bad.select(F.col("hash").alias("_bad"))
    return df.join(b, df[hash_] == F.col("_bad"), "left").withColumn(out, F.when(F.col("_bad").isNull(), F.col(hash_)).otherwise(F.concat_ws("-", hash_, _hex(F.col(sha))))).drop("_bad")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: one row per document."""
    rows = written(_hashed(_texts(docs)).select("doc_id", "mark", "hash", "sha"), "hashes")
    return _resolved(rows, small(collisions(docs, rows)), "hash", "sha", "fingerprint").select("doc_id", "fingerprint")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark, hash and sha of every document, and next_text, next_mark, next_hash, next_sha of the following one
    by ascending doc_id; the last is followed by the first. Null ids come first; equal ids are ordered by mark, then text.

    The ids are cut into ranges of about equal row counts, as many as their bytes ask for; an id (or null) that fills more
    than a range is cut further by its marks. Each row goes to its range, and the rows at a range's start go to the range
    before it as well, as followers only; so no range needs another, and texts are shuffled once."""
    keys = _texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "mark", F.octet_length("text").alias("bytes"))
    total = keys.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.col("doc_id").isNull().cast("long")).alias("nulls")).first()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4, min(MOST_RANGES, (total["bytes"] or 0) // RANGE_BYTES + 1))
    starts = block_starts(keys, "doc_id", ranges, alone=True)
    # ids that fill a range: they have a start, and the id after them has one
    hot = [k for k, after in zip(starts, starts[1:]) if after == k + 1]
    crowd = keys.where(F.col("doc_id").isin(hot) | F.col("doc_id").isNull() if (total["nulls"] or 0) * ranges > total["n"] else F.col("doc_id").isin(hot))
    each = written(crowd.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("mark").alias("least"), F.percentile_approx("mark", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges).alias("cuts")), "crowds")
    # as many cuts as the id's share of all rows asks for
    share = F.greatest(F.lit(1), F.ceil(F.lit(ranges) * F.col("n") / F.lit(max(total["n"], 1)))).cast("int")
    cuts = F.array_distinct(F.filter("cuts", lambda c, i: ((i + 1) * share % ranges < share) & (c > F.col("least"))))
    crowds = each.select(F.col("doc_id").alias("_hot"), "least", cuts.alias("cuts"))
    rows_of = {r["_hot"]: len(r["cuts"]) for r in crowds.select("_hot", "cuts").collect()}  # a row for each of few ids
    # each range begins with an id that is there, as its rows go to the range before too
    starts = sorted(r["least"] for r in keys.where("doc_id is not null").groupBy(block_of(F.col("doc_id"), starts).alias("block")).agg(F.min("doc_id").alias("least")).collect())
    null = 1 if total["nulls"] else 0
    sizes = ([rows_of.get(None, 0) + 1] if null else []) + [rows_of.get(k, 0) + 1 for k in starts]
    firsts = [sum(sizes[:i]) for i in range(len(sizes))]
    last = max(sum(sizes) - 1, 0)

    rows = _hashed(_texts(docs)).withColumn("_id", F.col("doc_id").cast("long"))
    rows = rows.join(F.broadcast(crowds), F.col("_id").eqNullSafe(F.col("_hot")) & F.lit(bool(rows_of)), "left")
    number = F.when(F.col("_id").isNull(), 0).otherwise(block_of(F.col("_id"), starts) + null)
    within = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("mark"))), F.lit(0))
    block = (F.element_at(F.array(*[F.lit(f) for f in firsts or [0]]), number + 1) + within).cast("int")
    at_start = F.when(F.col("least").isNotNull(), (F.col("mark") == F.col("least")) | F.array_contains("cuts", F.col("mark"))).otherwise(F.col("_id").isNull() | F.col("_id").isin(starts))
    opening = (F.col("_id").isNull() if null else F.col("_id") == F.lit(starts[0] if starts else 0)) & ((F.col("mark") == F.col("least")) | F.col("least").isNull())
    place = lambda b, follower, turn: F.struct(b.alias("block"), F.lit(follower).alias("follower"), F.lit(turn).alias("turn"))
    none = F.array().cast("array<struct<block:int,follower:boolean,turn:int>>")
    places = F.concat(F.array(place(block, False, 0)), F.when(at_start & (block > 0), F.array(place(block - 1, True, 0))).otherwise(none), F.when(opening, F.array(place(F.lit(last), True, 1))).otherwise(none))
    columns = ["text", "mark", "hash", "sha"]
    dealt = rows.select("doc_id", "_id", *columns, F.explode(places).alias("p")).select("doc_id", "_id", *columns, "p.*")
    w = Window.partitionBy("block").orderBy("turn", F.col("_id").asc_nulls_first(), "mark", "text", "follower")
    out = dealt.select("doc_id", *columns, "follower", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("not follower").drop("follower")


def _edited(text: Column, after: Column) -> Column:
    """The text with its last half (rounded down, in code points) replaced by as many code points, or all, from the next."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per document.

    The edited text is the text with its last half (rounded down, in code points) replaced by as many code points, or
    all, from the start of the next document. A likeness is 1 where hash and SHA-256 of the canonical bytes are equal, else
    0. Doc_ids are put in order as longs; those that are no numbers count as null."""
    rows = with_next(docs).withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "mark", "hash", "sha", "next_mark", "next_hash", "next_sha", _sha(F.col("edited")).alias("edited_sha"), canonical(F.col("edited")).alias("canon"))
    rows = written(rows.select("*", digest(F.col("canon")).alias("edited_hash"), _sha(F.col("canon")).alias("edited_canon_sha")).drop("canon"), "edited")
    bad = small(collisions(docs, rows))
    rows = _resolved(_resolved(rows, bad, "hash", "sha", "fingerprint"), bad, "edited_hash", "edited_canon_sha", "edited_fingerprint")
    equal = lambda h, s: F.when((F.col("hash") == F.col(h)) & (F.col("sha") == F.col(s)), 1.0).otherwise(0.0)
    return rows.select("doc_id", "n_chars", _hex(F.col("edited_sha")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", equal("edited_hash", "edited_canon_sha").alias("near_edited"), equal("next_hash", "next_sha").alias("near_next"))
