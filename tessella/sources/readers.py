"""DataFrame sources: PNG folders, sheets, scripts, archives, project folders; each file is decoded in the task that reads it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels as P
from . import containers, images, seal

PX = "frame bigint, x int, y int, r int, g int, b int, a int"


def files(spark: SparkSession, path: str, glob: str, recursive: bool = False) -> DataFrame:
    """path, content of matching files; fails without any."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    if df.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no {glob} in {path}")
    return df.select("path", "content")


def pngs(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, file, stem, number (of ``frame_NNN``, else null), content; ordered by path where that matters to the caller."""
    df = files(spark, path, "*.{png,PNG,Png}", recursive)
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"(?i)^frame_(\d+)\.png$", 1)
    return df.select("path", name.alias("file"), F.regexp_replace(name, r"(?i)\.png$", "").alias("stem"), F.when(number != "", number.cast("int")).alias("number"), "content")


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for frame, content in zip(b["frame"], b["content"]):
            im = images.decode_png(bytes(content))
            h, w = im.shape[:2]
            y, x = np.divmod(np.arange(h * w), w)
            flat = im.reshape(-1, 4).astype(np.int32)
            yield pd.DataFrame({"frame": frame, "x": x.astype(np.int32), "y": y.astype(np.int32), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "a": flat[:, 3]})


def pixels(pictures: DataFrame) -> DataFrame:
    """The pixel relation of (frame, content) rows, a PNG each."""
    return pictures.select(F.col("frame").cast("bigint").alias("frame"), "content").mapInPandas(_decoded, PX)


def project(spark: SparkSession, path: str) -> DataFrame:
    """anim, step, frame, rel_path, content of a folder: its own PNGs are the first animation, each subfolder is one more, by
    name; frames are numbered in that order."""
    df = pngs(spark, path, recursive=True)
    root = F.regexp_replace(F.lit(path.rstrip("/")), "^file:/*", "/")
    rel = F.expr("substring(path, instr(path, root) + length(root) + 1)")
    df = df.withColumn("root", root).withColumn("rel_path", rel).withColumn("group", F.when(F.col("rel_path").contains("/"), F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)).otherwise(""))
    order = Window.orderBy("group", "file")  # one row per file of one project
    df = df.withColumn("frame", (F.row_number().over(order) - 1).cast("int")).withColumn("anim", F.dense_rank().over(Window.orderBy("group")) - 1)
    return df.select("anim", (F.row_number().over(Window.partitionBy("anim").orderBy("frame")) - 1).alias("step"), "frame", "rel_path", "content")


def anchored(frames: DataFrame) -> DataFrame:
    """frame, x, y, z: the bottom centre of frames (frame, width, height)."""
    return frames.select("frame", P.div(F.col("width"), 2).alias("x"), (F.col("width") - P.div(F.col("width"), 2)).alias("y"), F.col("height").alias("z"))


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            try:
                s = containers.Sheet.parse(bytes(content))
            except ValueError as e:
                rows.append((path, -1, None, None, None, None, None, None, 0, str(e)))
                continue
            rows += [(path, i, f.width, f.height, f.placeholder, f.guessed_key(), f.words.astype(np.int32), s.header, s.trailing, None) for i, f in enumerate(s.frames)]
        out = pd.DataFrame(rows, columns=["sheet", "idx", "width", "height", "placeholder", "guessed_key", "words", "header", "trailing", "error"])
        yield out.astype({"width": "Int32", "height": "Int32", "guessed_key": "Int32", "placeholder": "boolean"})


def sheets(binary: DataFrame) -> DataFrame:
    """A row per frame of the sheets in (path, content); a file that is no sheet gives one row with idx -1 and its error."""
    return binary.select("path", "content").mapInPandas(_sheets, "sheet string, idx int, width int, height int, placeholder boolean, guessed_key int, words array<int>, header binary, trailing int, error string")


def sheet_pixels(frames: DataFrame, key: int | str | None = "auto", clear: bool = False) -> DataFrame:
    """Pixels of sheet frames; ``key`` is a word, None, or "auto" for each frame's guess. Placeholders have none."""
    one = frames.where("not placeholder").select("sheet", F.col("idx").cast("bigint").alias("frame"), "width", "guessed_key", F.posexplode("words").alias("i", "word"))
    k = F.col("guessed_key") if key == "auto" else F.lit(key).cast("int")
    is_key = F.coalesce(F.col("word") == k, F.lit(False))
    rgb = (P.from_565_scaled if clear else P.from_565)(F.col("word"))
    rgb = [F.when(is_key, 0).otherwise(c) if clear else c for c in rgb]
    return one.select("sheet", "frame", F.expr("i % width").alias("x"), F.expr("int(i div width)").alias("y"), *[c.alias(n) for c, n in zip(rgb, "rgb")], F.when(is_key, 0).otherwise(255).alias("a"))


def _scripts(per: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                s = containers.Script.parse(bytes(content), per)
                a, f = s.steps.shape[:2]
                anim, step = np.divmod(np.arange(a * f, dtype=np.int32), f)
                flat = s.steps.reshape(-1, 5)
                yield pd.DataFrame({"ani": path, "anim": anim, "step": step, **{n: flat[:, i].astype(np.int32) for i, n in enumerate(("frame", "x", "y", "z", "flag"))}, "last": s.last[anim].astype(np.int32)})

    return run


def scripts(binary: DataFrame, per: int | None = None) -> DataFrame:
    """A row per step of the scripts in (path, content): ani, anim, step, frame, x, y, z, flag, last."""
    return binary.select("path", "content").mapInPandas(_scripts(per), "ani string, anim int, step int, frame int, x int, y int, z int, flag int, last int")


def _archives(only: str | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, m.name, containers.base_name(m.name), len(m.content), m.compressed, m.content) for path, content in zip(b["path"], b["content"]) for m in containers.members(bytes(content)) if only is None or re.search(only, m.name)]
            yield pd.DataFrame(rows, columns=["archive", "name", "base", "size", "compressed", "content"])

    return run


def archives(binary: DataFrame, only: str | None = None) -> DataFrame:
    """A row per member of the archives in (path, content): archive, name, base, size, compressed, content."""
    return binary.select("path", "content").mapInPandas(_archives(only), "archive string, name string, base string, size bigint, compressed boolean, content binary")


@F.udf(T.StringType())
def sealed_name(header: bytes | None) -> str | None:
    """The name in a 64-byte header. One call per file."""
    return seal.name_of(bytes(header)) if header is not None else None


@F.udf(T.BinaryType())
def with_name(header: bytes | None, name: str | None) -> bytes | None:
    return seal.renamed(bytes(header or b""), name) if name is not None else None
