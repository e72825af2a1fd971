"""Track counts per filter stage and tables behind quality charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.joins import natural_join
from trackloom.operators.quantiles import group_quantiles
from trackloom.sources.tables import checkpointed

FUNNEL_KEYS = ["organoid_line", "tcell_line", "exp_nr", "well"]


def count_tracks(df: DataFrame, keys: list[str], track: str = "track_id", out: str = "nr_tracks") -> DataFrame:
    """Distinct tracks per experiment and well."""
    return df.groupBy(*keys).agg(F.count_distinct(track).alias(out))


def funnel(stages: dict[str, DataFrame], keys: list[str] | None = None, track: str = "track_id") -> DataFrame:
    """Track counts after each stage, side by side; experiments of the first stage stay, a missing count is null."""
    keys = keys or FUNNEL_KEYS
    counts = [count_tracks(df, keys, track, name) for name, df in stages.items()]
    return reduce(lambda x, y: natural_join([x, y], keys, "left"), counts)


def funnel_by_reach(reached: DataFrame, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """The funnel from rows (keys, track, _from, _reach) in one aggregation: the track passed the stages numbered ``_from`` to ``_reach`` under these keys.

    Keys of the first stage stay, a missing count is null.
    """
    keys = keys or FUNNEL_KEYS
    passed = [F.nullif(F.count_if((F.col("_from") <= i) & (F.col("_reach") >= i)), F.lit(0)).alias(n) for i, n in enumerate(stages)]
    return reached.groupBy(*keys).agg(*passed).filter(F.col(stages[0]).isNotNull())


def funnel_long(wide: DataFrame, stages: list[str], keys: list[str] | None = None) -> DataFrame:
    """The funnel as (keys.., stage, nr_tracks)."""
    return wide.unpivot(keys or FUNNEL_KEYS, stages, "stage", "nr_tracks")


def histogram(df: DataFrame, column: str, width: float, facets: list[str]) -> DataFrame:
    """Rows per bin of ``width`` and facet."""
    return df.groupBy(*facets, (F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def five_numbers(df: DataFrame, column: str, facets: list[str]) -> DataFrame:
    """Count, minimum, quartiles and maximum per facet, as a violin or box chart shows them; a facet may be of any size."""
    rows = checkpointed(df.select(*facets, column).withColumn("_facet", F.to_json(F.struct(*facets))))
    ends = rows.groupBy("_facet", *facets).agg(F.count(column).alias("n"), F.min(column).alias("lowest"), F.max(column).alias("highest"))
    quartiles = group_quantiles(rows, "_facet", {"q25": (column, 0.25), "q50": (column, 0.5), "q75": (column, 0.75)})
    return ends.join(quartiles, "_facet").select(*facets, "n", "lowest", "q25", "q50", "q75", "highest")
