"""The row-local steps of the analyses on a stream of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.columns import at_most_is_contact, dead_flag, ratio


def flagged(stream: DataFrame, duration: float) -> DataFrame:
    """Time cut and contact and death flags; each row on its own."""
    rows = stream.filter(F.col("time") <= duration)
    return rows.withColumns({"contact": at_most_is_contact("dist_org", "organoid_contact_threshold"), "death": dead_flag("red_lym", "tcell_dead_dye_threshold")})


def merged_fragments(stream: DataFrame, event_time: str, delay: str, window: str, keys: list[str]) -> DataFrame:
    """Sums and volume-weighted mean dye per object and event-time window; windows close ``delay`` after their end."""
    late = stream.withWatermark(event_time, delay)
    sums = late.groupBy(F.window(event_time, window), *keys).agg(F.sum("volume").alias("volume"), F.sum(F.col("dead_dye_mean") * F.col("volume")).alias("dead_dye_sum"))
    return sums.withColumn("dead_dye_mean", ratio("dead_dye_sum", "volume"))
