import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.coalescePartitions.enabled", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


def px_of(spark, rows):
    """Pixels from (frame, x, y, r, g, b, a) rows."""
    return spark.createDataFrame(rows, "frame bigint, x int, y int, r int, g int, b int, a int")


def picture(text, colours, frame=0):
    """Rows of a picture drawn in letters; a dot is clear."""
    out = []
    for y, line in enumerate(text.split()):
        for x, c in enumerate(line):
            out.append((frame, x, y, *((0, 0, 0, 0) if c == "." else (*colours[c], 255))))
    return out
