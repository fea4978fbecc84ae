"""All queries of the engine by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_frames, queries_pixels, queries_votes

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (queries_pixels, queries_votes, queries_frames)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of enlarged frames voted back to pixels."""
    return queries()["a01_block_vote"](spark, sf_dir)
