"""URL filters: a blocked Bloom filter over listed canonical keys, then an exact hash join.

A rule is a host and a path. It fits a url whose host is the rule's or a subdomain of it, and whose path starts with the
rule's path; of the rules that fit, the longest wins, then the one that blocks, then the first in code point order.

Canonical host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
``?``, ``#`` or the end. A null url, or one without ``://``, has an empty host and path and fits no rule.

Each url gives a candidate key per ending of its host at a dot and per length of path that occurs among the rules. A key
is hashed to one block of the filter, a few bits of 256, so a lookup touches one row; keys that all bits of pass join the
rules by equality, which removes the false positives. The filter is made by ``bit_or`` per block, has a fixed size chosen
from the count of rules, and is broadcast while its bytes are few; so is nothing else.

Urls on no rule get ``default``. Repeated rules count once; null rule parts never fit. Repeated rows are judged each.
Columns besides page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Blocks of 256 bits (40 bytes as rows) up to which the filter is broadcast, and keys per block.
KEYS_PER_BLOCK, BITS = 16, 6
#: Lengths of rule paths that go into the plan as a constant.
MANY_LENGTHS = 10_000


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bits(key: Column) -> list[Column]:
    """Four 64-bit words with the key's bits, from slices of one hash."""
    h = F.xxhash64(F.lit(7), key)
    words: list[Column] = []
    for w in range(4):
        out = F.lit(0).cast("long")
        for i in range(BITS):
            piece = F.shiftrightunsigned(h, 8 * i)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), piece.bitwiseAND(F.lit(63)).cast("int"))
            here = F.shiftrightunsigned(piece, 6).bitwiseAND(F.lit(3)) == w
            out = out.bitwiseOR(F.when(here, bit).otherwise(F.lit(0).cast("long")))
        words.append(out)
    return words


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter over column ``key``, a row for each block with bits."""
    return keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row per page. ``rules`` has host, path and verdict ("allow" or "block")."""
    r = rules.where("host is not null and path is not null and host <> ''").select(F.concat_ws(" ", "host", "path").alias("key"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("_verdict"), F.length("path").alias("n"))
    # of rules alike, the one that blocks
    r = written(r.groupBy("key", "rule", "n").agg(F.max("_verdict").alias("_verdict")), "rules")
    lengths = [x["n"] for x in r.select("n").distinct().orderBy("n").limit(MANY_LENGTHS + 1).collect()]
    count = r.count()
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    table = small(bloom(r, blocks), blocks)
    urls = pages.select(F.col("page_id"), host(F.col("url").cast("string")).alias("host"), path(F.col("url").cast("string")).alias("path"))
    # lengths of rule paths as a constant; where there are many, all lengths of the page's own path
    lens = F.array(*[F.lit(n) for n in lengths]).cast("array<int>") if len(lengths) <= MANY_LENGTHS else F.sequence(F.lit(0), F.char_length("path"))
    parts = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.filter(lens, lambda n: n <= F.char_length("path"))
    keys = F.flatten(F.transform(endings, lambda e: F.transform(fits, lambda n: F.concat_ws(" ", e, F.substring(F.col("path"), F.lit(1), n)))))
    # Pages are told by a number of their own: page_id may repeat or be null. Judging needs distinct (host, path) only.
    places = urls.select("host", "path").where("host <> ''").distinct()
    asked = places.select("host", "path", F.explode(keys).alias("key"))
    asked = asked.select("*", _block(F.col("key"), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))])
    passed = asked.join(table, "block")
    for i in range(4):
        passed = passed.where(F.col(f"w{i}").bitwiseAND(F.col(f"b{i}")) == F.col(f"b{i}"))
    hits = passed.select("host", "path", "key").join(small(r.select("key", "rule", "_verdict")), "key")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.char_length("rule")).alias("k"), F.when(F.col("_verdict") == "block", 0).otherwise(1).alias("b"), F.col("rule"), F.col("_verdict"))).alias("m"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("m.rule").alias("rule"), F.col("m._verdict").alias("_verdict"))
    out = urls.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
