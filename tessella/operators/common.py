"""What the pixel operators share. A pixel relation has frame, x, y, r, g, b, a; one frame fits into a task's memory (at most
4096 by 4096 pixels), frames are many. Operators that look at neighbours shuffle once, by frame: windows and groupings by frame
and more columns then need no further exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
RGB = ("r", "g", "b")
RGBA = ("r", "g", "b", "a")
NB4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
NB8 = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
#: Palette entries or literal rows up to which a side is broadcast without asking: 16-bit colours have no more.
FIXED_ROWS = 65_536


def rgb(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(C(f"{prefix}{c}") for c in RGB)


def by_frame(px: DataFrame) -> DataFrame:
    return px.repartition("frame")


def scattered(px: DataFrame, offsets: list[tuple[int, int]], values: list[str]) -> DataFrame:
    """Each pixel's values sent to itself (_k = -1) and to the pixel at each offset (_k: the offset's number), so that what
    arrives at (frame, x, y) are the pixel and its neighbours. The offset leads from the receiver to the sender."""
    places = [F.struct(F.lit(-1).alias("k"), C("x").alias("tx"), C("y").alias("ty"))]
    places += [F.struct(F.lit(k).alias("k"), (C("x") - dx).alias("tx"), (C("y") - dy).alias("ty")) for k, (dx, dy) in enumerate(offsets)]
    return by_frame(px.select("frame", "x", "y", *values)).select("frame", F.explode(F.array(*places)).alias("_to"), *values).select("frame", C("_to.tx").alias("x"), C("_to.ty").alias("y"), C("_to.k").alias("_k"), *values)


def neighbours(px: DataFrame, offsets: list[tuple[int, int]], values: list[str]) -> DataFrame:
    """frame, x, y, the pixel's values, and ``nb``: an array of structs (k, values) of the neighbours that exist, by k. At most
    as many as there are offsets."""
    s = scattered(px, offsets, values)
    own = [F.max(F.when(C("_k") == -1, C(v))).alias(v) for v in values]
    nb = F.array_sort(F.collect_list(F.when(C("_k") >= 0, F.struct(C("_k").alias("k"), *values)))).alias("nb")
    return s.groupBy("frame", "x", "y").agg(F.max(F.when(C("_k") == -1, 1)).alias("_here"), *own, nb).where("_here = 1").drop("_here")


def shifted(px: DataFrame, dx: Column | int, dy: Column | int) -> DataFrame:
    return px.withColumns({"x": C("x") + dx, "y": C("y") + dy})
