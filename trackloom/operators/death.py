"""Death of organoids over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.columns import dead_flag, hours, ratio
from trackloom.operators.filters import complete_rows, tracks_of_length
from trackloom.operators.joins import complete_grid
from trackloom.operators.series import carry_forward, curve_summary, fill_forward, minus_first, sticky

WELL_KEY = ["organoid_line", "tcell_line", "exp_nr", "well", "date"]


def merge_fragments(df: DataFrame) -> DataFrame:
    """One row per organoid and time: sums of volume, dye and area, the mean position where there is one, the volume-weighted mean dye, hours."""
    position = [c for c in ("pos_x", "pos_y", "pos_z") if c in df.columns]
    merged = df.groupBy("track_id", "time", *WELL_KEY).agg(
        F.sum("volume").alias("volume"), F.sum(F.col("dead_dye_mean") * F.col("volume")).alias("dead_dye_sum"), F.sum("area").alias("area"), *[F.avg(c).alias(c) for c in position]
    )
    return complete_rows(merged.withColumn("dead_dye_mean", ratio("dead_dye_sum", "volume"))).withColumn("time2", hours("time"))


def well_curve(organoids: DataFrame, min_length: int) -> DataFrame:
    """Volume, dye sum and weighted mean dye per well and time, over organoids with more than ``min_length`` times."""
    long = tracks_of_length(organoids, min_length, strict=True)
    curve = long.groupBy("time", "time2", *WELL_KEY).agg(F.sum("volume").alias("volume"), F.sum("dead_dye_sum").alias("dead_dye_sum"))
    return curve.withColumn("dead_dye_mean", ratio("dead_dye_sum", "volume"))


def track_maxima(organoids: DataFrame, columns: list[str]) -> DataFrame:
    """Largest value of each column per organoid."""
    return organoids.groupBy("track_id", *WELL_KEY).agg(*[F.max(c).alias(f"max_{c}") for c in columns])


def auc_and_delta(curve: DataFrame, value: str, duration: float) -> DataFrame:
    """Area and increase of the curve minus its first value, over times below ``duration``."""
    shifted = minus_first(curve, value, "_shifted", WELL_KEY, "time2").filter(F.col("time") < duration)
    return curve_summary(shifted, "time2", "_shifted", WELL_KEY)


def percentage_dead(organoids: DataFrame, threshold: Column, *, fill_scope: str = "well") -> DataFrame:
    """Dead organoids per well and time, as number and percentage of the starting number, and the percentage minus its first value.

    Missing (time, organoid) rows take the values before them: ``well`` takes
    the row before in order of time and id, whichever organoid it is of, and
    ``track`` the organoid's own. The starting number counts rows at time 1.
    """
    flagged = organoids.withColumn("dead", dead_flag("dead_dye_mean", threshold))
    grid = complete_grid(flagged.select(*WELL_KEY, "time", "track_id", "dead"), WELL_KEY, "time", "track_id")
    filled = carry_forward(grid, ["dead"], WELL_KEY, ["time", "track_id"]) if fill_scope == "well" else fill_forward(grid, ["dead"], [*WELL_KEY, "track_id"], ["time"])
    dead = sticky(filled, "dead", [*WELL_KEY, "track_id"])
    counts = dead.groupBy("time", *WELL_KEY).agg(F.coalesce(F.sum(F.when(F.col("dead") == 1, 1)), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("_rows"))
    start = counts.groupBy(*WELL_KEY).agg(F.max(F.when(F.col("time") == 1, F.col("_rows"))).alias("starting_nr_organoids"))
    shares = counts.drop("_rows").join(start, WELL_KEY).withColumn("perc", F.try_divide(F.col("n") * 100, "starting_nr_organoids"))
    return minus_first(shares, "perc", "perc_dead_norm", WELL_KEY)
