"""Statistic files written from tables, in the layout that ``measurements`` reads."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.sources.statistics import FORMAT, register
from trackloom.sources.tables import checkpoint_root


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder of its own below the checkpoint folder, which all executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def statistic_lines(rows: DataFrame, folder: Column, file: Column, header: str, values: list[Column]) -> DataFrame:
    """(folder, file, header, line): one line of a statistic file for each row; nulls are empty fields."""
    text = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return rows.select(folder.alias("folder"), file.alias("file"), F.lit(header).alias("header"), F.concat(F.concat_ws(",", *text), F.lit(",")).alias("line"))


def write_statistics(lines: DataFrame, root: str) -> None:
    """Write ``folder/file`` below the URI ``root`` for each (folder, file) of ``lines``: a preamble, the header and the lines, sorted.

    A file's lines go to one task, which streams them; files appear under their
    names when all are written, so a repeated task leaves nothing half done.
    """
    register(lines.sparkSession)
    rows = lines.repartition("folder", "file").sortWithinPartitions("folder", "file", "line").select("folder", "file", "header", "line")
    rows.write.format(FORMAT).mode("append").save(root)
