"""Joins that the analyses share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.ids import require_unique
from trackloom.sources.tables import written


def natural_join(tables: list[DataFrame], keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; other columns must have different names."""

    def pair(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
        same = reduce(lambda x, y: x & y, (left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys))
        return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])

    return reduce(pair, tables)


def with_observations(metadata: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata with its observations; an experiment without any keeps one row of nulls."""
    return natural_join([metadata, observations], keys, "left")


def with_metadata(observations: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with the metadata of their experiment. Spark broadcasts the metadata if it is small."""
    return natural_join([observations, metadata], keys, "left")


def join_once(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``natural_join`` with a right side that has each key once; DuplicateRows if it has not, as rows of the left would multiply."""
    return natural_join([left, require_unique(right, keys)], keys, how)


def stacked(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def complete_grid(df: DataFrame, group: list[str], time: str, track: str) -> DataFrame:
    """Every time of a group for every track of it; rows that were missing have nulls.

    The rows are read three times, so they are written first. Such files are far
    smaller than their rows in memory, so Spark is told to sort and merge them
    and never broadcasts them by the size of the files.
    """
    df = written(df, "grid-rows")
    times, tracks = df.select(*group, time).distinct(), df.select(*group, track).distinct()
    return natural_join([natural_join([times, tracks], group), df.hint("merge")], [*group, time, track], "left")


def zero_fill(shares: DataFrame, label: str, group: list[str], totals: str, zeros: list[str]) -> DataFrame:
    """Add a row of zeros for every label that a group lacks; ``totals`` is carried over.

    The labels are a handful; they travel as one array, so no cross product of tables is planned.
    """
    labels = shares.groupBy(F.lit(1).alias("_one")).agg(F.collect_set(label).alias("_labels"))
    groups = shares.groupBy(*group).agg(F.max(totals).alias(totals)).withColumn("_one", F.lit(1))
    grid = groups.join(labels, "_one").select(*group, totals, F.explode("_labels").alias(label))
    have = shares.select(*group, label, *zeros)
    return natural_join([grid, have], [*group, label], "left").fillna(0, subset=zeros)
