"""Tables between steps: save, load, reuse, checkpoints, delimited and per-experiment outputs."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def save(df: DataFrame, path: str, *, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in whatever file system it names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def reused(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force: bool = False, given: DataFrame | None = None) -> DataFrame:
    """The given table, or the saved one; built and saved first if it is missing, a build of it failed half way, or ``force`` is set."""
    if given is not None:
        return given
    if force or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        save(build(), path)
    return load(spark, path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Text with a header, for people and spreadsheets."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_id_lists(lists: DataFrame, path: str, experiment: str) -> None:
    """Class -> ids as JSON, one folder per experiment."""
    lists.write.mode("overwrite").partitionBy(experiment).json(path)


def checkpoint_root(spark: SparkSession) -> str:
    """URI of ``spark.checkpoint.dir``, which all executors share; unset on a local master, a temporary folder."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured and context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return (configured or _LOCAL[context.applicationId]).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint below ``checkpoint_root``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below ``checkpoint_root`` and read it from there: it cuts the lineage as a checkpoint does, and Spark learns the table's size."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, folder: str) -> str:
    """A digest of the names, sizes and times of the files of a folder, in whatever file system it names; of the name alone where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = []
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True) if exists(spark, folder) else None
    while files is not None and files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join([folder, *sorted(found)]).encode()).hexdigest()


def session_table(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one application derive from the files of ``source``: built and saved by the first, reused by the others while the files stay as they are."""
    key = state_of(spark, source)[:16]
    return reused(spark, f"{checkpoint_root(spark)}/{name}-{spark.sparkContext.applicationId}-{key}", build)
