"""Write an intermediate result once when several later steps read it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the rows of one batch between an executor and its Python workers.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, which all executors reach.

    Where none is named, a folder beside the tables of the session's warehouse, which
    executors share as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Meanwhile no batch for a Python worker has more rows than this; a smaller setting stays."""
    before = int(spark.conf.get(BATCH_ROWS))
    if 0 < before <= rows:
        yield
        return
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, str(before))


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of a query go when it ends; one that is run twice shuffles twice."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write to Parquet in the shared folder and read back.

    The lineage is cut there, the result survives the loss of any executor, and later
    passes read only the columns they use. The shuffle files of the write go with it.
    ``discard`` deletes a table, ``release`` all that have been written.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    with cleaned_up(spark):
        df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames; nothing may read them any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            if path in _WRITTEN:
                _WRITTEN.remove(path)
                _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def release(spark: SparkSession) -> int:
    """Delete the tables written so far by this driver; frames built on them end with that."""
    done = 0
    while _WRITTEN:
        done += _delete(spark, _WRITTEN.pop())
    return done
