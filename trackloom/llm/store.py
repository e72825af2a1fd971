"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PYTHON_ROWS = 1024  # rows that go to Python at a time while a table is stored

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session names it.

    Where it is unset, a local master gets a temporary folder of its own (one
    per application); on a cluster that would lose data, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = PYTHON_ROWS) -> Iterator[None]:
    """Inside, at most ``rows`` rows at a time go to Python, so that long texts don't fill a worker's memory; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, *, batch_rows: int = PYTHON_ROWS) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    It cuts the lineage: what follows survives lost executors without running
    the steps before it again, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
