"""Helpers the text operators share: lineage cuts, size-checked broadcasts, word splitting, block ranges."""

from __future__ import annotations

import contextlib
import ctypes
import math
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` without arguments splits alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes up to which a side is broadcast, counted as ROW_BYTES a row, eight for each number and those of texts and binaries.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 40
#: Bytes of an Arrow batch of texts.
BATCH = 4 << 20
#: Paths of the tables made inside each open :func:`scratch`.
_MADE: list[list[str]] = []
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir``; a temporary one of our own only where
    that is unset (local sessions such as tests)."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tessella/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and keeps fewer bytes
    than a row checkpoint. It lives until :func:`removed`, the end of an enclosing :func:`scratch`, or the removal of the
    application's folder."""
    path = new_path(df.sparkSession, what)
    for made in _MADE[-1:]:
        made.append(path)
    return stored(df, path)


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    _delete(spark, {x.rsplit("/", 1)[0] for df in tables for x in df.inputFiles() if "/tessella/" in x})


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if all its rows take at most BROADCAST_BYTES; otherwise as it is, for a shuffled join.
    ``df`` is run for that (it should be a stored table or little work) unless it has but numbers and ``rows`` says how many."""
    if rows is not None:
        return F.broadcast(df) if rows * (ROW_BYTES + 8 * len(df.columns)) <= BROADCAST_BYTES else df
    width = [F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema.fields]
    size = df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in width), F.lit(ROW_BYTES)).cast("long")).alias("bytes")).first()
    return F.broadcast(df) if (size["bytes"] or 0) <= BROADCAST_BYTES else df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted at the end; what is still needed must be stored elsewhere by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.pop()
        _delete(spark, made)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Gives memory that this worker no longer uses back to the machine: other operators' tasks follow in the same process."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for texts: batches are of BATCH bytes at most (for the session, from here on), as ten thousand texts and
    their copies on both sides would fill an executor, and a task trims its worker's memory at its end."""
    conf = df.sparkSession.conf
    now = str(conf.get(_BYTES))
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH:
        conf.set(_BYTES, f"{BATCH}b")

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return df.mapInArrow(tidy, schema)


def checksum_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the folds of learners."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def block_starts(df: DataFrame, key: str, blocks: int, alone: bool = False) -> list[int]:
    """Up to ``blocks`` ascending values of ``key`` that cut it into ranges of about equal row counts. The first is the
    least value; all are keys, but that with ``alone`` a key that fills a range has one to itself. A mergeable quantile sketch
    over all rows; empty without keys."""
    parts = [i / blocks for i in range(1, blocks)] or [0.5]
    row = df.agg(F.min(key).alias("least"), F.percentile_approx(key, parts, max(20_000, 10 * blocks)).alias("cuts")).first()
    if row is None or row["least"] is None:
        return []
    cuts = [row["least"], *row["cuts"]]
    return sorted({*cuts, *(k + 1 for k, c in Counter(cuts).items() if alone and c > 1 and k < 2**63 - 1)})


def block_of(key: Column, starts: Sequence[int]) -> Column:
    """The number of the range that holds ``key`` (0 for null keys and those under the first start)."""
    if len(starts) < 2:
        return F.lit(0)
    cuts = [int(s) for s in starts[1:]]
    step = math.isqrt(len(cuts) - 1) + 1
    array = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<bigint>")
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    # Two steps over constant arrays, about the square root of the ranges each: no join for a few thousand ranges.
    coarse = below(array(cuts[step - 1 :: step]))
    return F.when(key.isNull(), 0).otherwise(coarse * step + below(F.slice(array(cuts), coarse * step + 1, F.lit(step)))).cast("int")
