"""Pixel relations derived from the supplied tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PX_SQL = """px AS (
  SELECT CAST(floor(event_id / 256.0) AS BIGINT) AS frame, CAST(event_id % 16 AS INT) AS x, CAST(floor((event_id % 256) / 16.0) AS INT) AS y,
         CAST((user_id * 37) % 256 AS INT) AS r, CAST(CAST(floor(value) AS BIGINT) % 256 AS INT) AS g, CAST((event_id * 29) % 256 AS INT) AS b,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 255 END AS INT) AS a FROM events)"""
ALT_SQL = """alt AS (SELECT frame, x, y, CASE WHEN (frame * 256 + y * 16 + x) % 7 = 0 THEN (r + 8) % 256 ELSE r END AS r, g, b,
  CASE WHEN (frame * 256 + y * 16 + x) % 11 = 0 THEN 0 ELSE a END AS a FROM px)"""
FLAT_SQL = "flat AS (SELECT frame, x, y, (r // 96) * 96 AS r, (g // 96) * 96 AS g, (b // 128) * 128 AS b, a FROM px)"
FG_SQL = "fg AS (SELECT frame, x, y FROM px WHERE r < 110)"
GRAY_SQL = """gray AS (SELECT vec_id AS frame, CAST((i - 1) % 8 AS INT) AS x, CAST((i - 1) // 8 AS INT) AS y, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 128) AS INT) AS v, label
  FROM (SELECT vec_id, embedding, label, unnest(generate_series(1, 64)) AS i FROM embeddings))"""
STEPS_SQL = """steps AS (SELECT CAST(o_custkey % 50 AS INT) AS anim, CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS INT) AS step,
  CAST(CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_orderkey % 40 END AS INT) AS frame, CAST(o_orderkey % 13 AS INT) AS x, CAST(o_custkey % 11 AS INT) AS y, CAST(o_orderkey % 7 AS INT) AS z FROM orders),
lasts AS (SELECT anim, CAST(max(step) // 2 AS INT) AS last FROM steps GROUP BY anim)"""
#: The first eight colours of a preset, in order.
PALETTE = [(0, 0, 0), (29, 43, 83), (126, 37, 83), (0, 135, 81), (171, 82, 54), (194, 195, 199), (255, 241, 232), (255, 0, 77)]
PALETTE_SQL = "pal(ord, pr, pg, pb) AS (VALUES " + ", ".join(str((i, *c)) for i, c in enumerate(PALETTE)) + ")"
BG = (255, 0, 255)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 by 16 frames, one per 256 events; about a fifth of the pixels is transparent."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.floor(i / 256).alias("frame"), (i % 16).cast("int").alias("x"), F.floor(i % 256 / 16).cast("int").alias("y"),
        (F.col("user_id") * 37 % 256).cast("int").alias("r"), (F.floor("value").cast("bigint") % 256).cast("int").alias("g"), (i * 29 % 256).cast("int").alias("b"),
        F.when(F.col("event_type") == "error", 0).otherwise(255).alias("a"),
    )


def alt(p: DataFrame) -> DataFrame:
    """An edit of px: every seventh pixel is redder, every eleventh transparent."""
    i = F.col("frame") * 256 + F.col("y") * 16 + F.col("x")
    return p.select("frame", "x", "y", F.when(i % 7 == 0, (F.col("r") + 8) % 256).otherwise(F.col("r")).alias("r"), "g", "b", F.when(i % 11 == 0, 0).otherwise(F.col("a")).alias("a"))


def flat(p: DataFrame) -> DataFrame:
    """px in a few colours, so that neighbours and votes agree often."""
    cut = lambda c, n: (F.floor(F.col(c) / n) * n).cast("int").alias(c)
    return p.select("frame", "x", "y", cut("r", 96), cut("g", 96), cut("b", 128), "a")


def fg(p: DataFrame) -> DataFrame:
    return p.where("r < 110").select("frame", "x", "y")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 by 8 grey frames from vectors of 64 values; v is the grey, label the animation."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label", F.posexplode("embedding").alias("i", "e"))
    return e.select("frame", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.floor((F.col("e").cast("double") + 1) * 128).cast("int").alias("v"), "label")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anim, step, frame, x, y, z, last of animations made of orders."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    w = Window.partitionBy("anim").orderBy("o_orderkey")
    s = o.select((c % 50).cast("int").alias("anim"), "o_orderkey", F.when(i % 9 == 0, -1).otherwise(i % 40).cast("int").alias("frame"), (i % 13).cast("int").alias("x"), (c % 11).cast("int").alias("y"), (i % 7).cast("int").alias("z"))
    s = s.withColumn("step", (F.row_number().over(w) - 1).cast("int"))
    return s.select("anim", "step", "frame", "x", "y", "z", F.floor(F.max("step").over(Window.partitionBy("anim")) / 2).cast("int").alias("last"))


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(PALETTE)], "ord int, pr int, pg int, pb int")
