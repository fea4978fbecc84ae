"""New frames as a stream: PNG files that arrive in a folder are decoded, put on a palette and written, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import palette_ops
from ..sources import readers

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """frame (of ``frame_NNN.png``), modified, content of files as they arrive."""
    s = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.png").load(folder)
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^frame_(\d+)\.png$", 1)
    return s.where(number != "").select(number.cast("bigint").alias("frame"), F.col("modificationTime").alias("modified"), "content")


def conformed(spark: SparkSession, folder: str, palette: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes pixels of arriving frames on the palette as Parquet under ``out``; ends when the files present are done."""
    px = readers.pixels(arriving(spark, folder)).where("a >= 128")
    done = palette_ops.with_nearest(px, palette).select("frame", "x", "y", *[F.col(f"_m.p{c}").alias(c) for c in "rgb"], "a")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(frames: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of arriving frames per window; rows later than ``late`` are dropped by the watermark."""
    return frames.withWatermark("modified", late).groupBy(F.window("modified", every)).agg(F.count("*").alias("n")).select("window.start", "window.end", "n")
