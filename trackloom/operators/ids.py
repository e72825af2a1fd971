"""Track ids, duplicates and distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import text_or_na


class DuplicateRows(ValueError):
    """A key that must be unique occurs more than once."""


def unique_track_ids(df: DataFrame, experiment: list[str], track: str = "track_id") -> DataFrame:
    """Number the experiments in order of their joined names and put the number before each track id.

    The id of before is kept as ``original_track_id``; a null id becomes "NA".
    Only the distinct experiments are ranked, then joined back.
    """
    name = F.concat(*[text_or_na(c) for c in experiment])
    named = df.withColumn("_experiment", name)
    ranked = named.select("_experiment").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("_experiment")))
    out = named.join(ranked, "_experiment").withColumn("original_track_id", F.col(track))
    return out.withColumn(track, F.concat_ws("_", F.col("_rank").cast("string"), text_or_na(track))).drop("_experiment", "_rank")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows as they are, or DuplicateRows. Runs one aggregation at once."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise DuplicateRows(f"{found[0].asDict()} in {keys}")
    return df


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given (total) order."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_place = 1").drop("_place")
