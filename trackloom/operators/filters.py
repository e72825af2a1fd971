"""Row and track filters. Bounds are strict or not as their names and texts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def until(df: DataFrame, duration: float, time: str = "time") -> DataFrame:
    """Times up to and with ``duration``; unknown times go."""
    return df.filter(F.col(time) <= duration)


def between(df: DataFrame, low: float, high: float, time: str = "time") -> DataFrame:
    """Times above ``low`` and below ``high``, without both."""
    return df.filter((F.col(time) > low) & (F.col(time) < high))


def tracks_of_length(df: DataFrame, rows: int, track: str = "track_id", *, strict: bool = False) -> DataFrame:
    """Tracks with at least ``rows`` rows, or with more if strict."""
    counted = df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(track)))
    return counted.filter(F.col("_rows") > rows if strict else F.col("_rows") >= rows).drop("_rows")


def truncated(df: DataFrame, length: float, relative_time: str = "time2") -> DataFrame:
    """The part of each track below ``length`` on its own clock."""
    return df.filter(F.col(relative_time) < length)


def tracks_where(df: DataFrame, condition: Column, track: str = "track_id") -> DataFrame:
    """All rows of the tracks that have a row for which ``condition`` holds."""
    met = F.max(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(track))  # df is derived once, as a semi-join with itself would not
    return df.withColumn("_met", met).filter(F.col("_met") & F.col(track).isNotNull()).drop("_met")


def alive_at_start(df: DataFrame, threshold: Column, signal: str = "red_lym", track: str = "track_id", relative_time: str = "time2") -> DataFrame:
    """Tracks whose signal is below the threshold at their first point."""
    return tracks_where(df, (F.col(relative_time) == 0) & (F.col(signal) < threshold), track)


def alive_and_large_at_start(df: DataFrame, threshold: Column, min_volume: float, track: str = "track_id", time: str = "time") -> DataFrame:
    """Tracks that at their first time have a dye mean below the threshold and a volume above ``min_volume``."""
    first = df.withColumn("_first", F.min(time).over(Window.partitionBy(track)))
    good = (F.col(time) == F.col("_first")) & (F.col("dead_dye_mean") < threshold) & (F.col("volume") > min_volume)
    return tracks_where(first, good, track).drop("_first")


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN."""
    return df.dropna(how="any", subset=columns)


def ever_dead(df: DataFrame, threshold: Column, maximum: str = "max_dead_dye_mean") -> tuple[DataFrame, DataFrame]:
    """Rows of tracks whose maximum is above the threshold, and the others."""
    return df.filter(F.col(maximum) > threshold), df.filter(F.col(maximum) <= threshold)


def without_class(df: DataFrame, label: str, outlier: object) -> DataFrame:
    """Drop the class of outliers."""
    return df.filter(F.col(label) != F.lit(outlier))
