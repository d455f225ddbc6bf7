"""Helpers that the operators share: tables, and results written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in all contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Rows of a batch that goes to a Python worker, where the session has Spark's default of 10,000.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: ten thousand of them fill tens of MB on both sides of a worker's pipe. A session that
    names another size than Spark's default keeps its own."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of sessions that name none (tests).
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        app = spark.sparkContext.applicationId
        where = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="wordloom-")
        _own[app] = where
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wordloom-{uuid.uuid4().hex}/{name}"


#: Folders of tables that a ``passing`` block gives up at its end, innermost block last.
_passing: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, sizes known to the planner. It goes with the innermost
    ``passing`` block; ``keep`` hands it to the block around that."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    owners = _passing[:-1] if keep else _passing
    if owners:
        owners[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Deletes at its end what was written in it and not kept. What leaves the block must not read from that."""
    _passing.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _passing.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def words_in(col) -> "F.Column":
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches, rows: int = 1000):
    """Arrow batches in smaller pieces, so that what a worker makes of one at a time stays small.

    Workers outlive their tasks, and what their allocators keep counts against later stages: Arrow allocates
    from the system here, and free memory goes back after each batch.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
            b = None
            give_back()
    finally:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns free memory to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
