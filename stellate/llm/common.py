"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so batches hold few rows.
BATCH_ROWS = 256

_lock = threading.Lock()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, func, schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow in slices of few rows, so that what `func` makes of long texts stays within a worker's memory.

    Spark bounds the batches themselves by bytes."""

    def sliced(batches):
        return func(batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))

    return df.mapInArrow(sliced, schema)


class Kept(dict):
    """A worker's dictionary of looked-up values that holds about `most` bytes, then starts anew."""

    def __init__(self, most: int):
        self.most, self.left = most, most

    def keep(self, key, value, size: int):
        self.left -= size + 250  # of the objects and the entry
        if self.left < 0:
            self.clear()
            self.left = self.most
        self[key] = value
        return value


def trimmed() -> None:
    """Gives this process's free memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def freed(spark: SparkSession) -> None:
    """Frees the driver of plans that are done with. Operators that make many would else fill its memory;
    nothing depends on it but that memory, as shuffles are removed when their results are written."""
    trimmed()
    spark._jvm.System.gc()


_held: list = [None, None]


def held(name, make=lambda: None):
    """What one operator keeps in a worker from task to task. A worker serves many operators in
    turn, so what another one kept is given back first."""
    if _held[0] != name:
        _held[:] = [None, None]
        trimmed()
        _held[:] = [name, make()]
    return _held[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI or path.

    The session names it in spark.checkpoint.dir; only where that is unset and all runs
    on one machine, as in tests, a folder under /tmp is set.
    """
    with _lock:
        there = spark.conf.get("spark.checkpoint.dir", None)
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not there and not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(there or f"/tmp/checkpoints/{uuid.uuid4().hex}")
        return there or jsc.getCheckpointDir().get()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is no longer read, on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Plans made and run in this block delete their shuffle files when they end, as their results are written down."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: its lineage and its shuffles end there."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def text_rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Only the id, the text and `more` columns, under fixed names; null texts become empty.

    Any other column, whatever its name, is left behind here.
    """
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )
