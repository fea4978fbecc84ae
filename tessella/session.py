"""A session with the settings the engine is written for. On a cluster, use the cluster's own session and set spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{cores}]").appName("tessella").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s
