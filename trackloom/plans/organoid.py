"""Death dynamics of organoids, per well and one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import death, filters, normalize, series
from trackloom.sources.tables import written


def individual_curves(organoids: DataFrame, threshold: Column, min_length: int, min_volume: float) -> DataFrame:
    """Organoids that start alive and large: the rescaled dye, held at its maximum once the maximum is reached. They are read for their ends, their maxima and themselves, so they are written first."""
    scaled = normalize.rescaled(written(organoids, "organoid-rows"), {"dead_dye_mean": "dead_dye_mean_rescaled"}, (0.0, 100.0))
    long = filters.tracks_of_length(scaled, min_length, strict=True)
    with_max = long.join(death.track_maxima(long, ["dead_dye_mean", "dead_dye_mean_rescaled"]), ["track_id", *death.WELL_KEY])
    alive = filters.alive_and_large_at_start(with_max, threshold, min_volume)
    return series.plateau(alive, "dead_dye_mean", "dead_dye_mean_rescaled", "max_dead_dye_mean_rescaled")


def auc_table(curve: DataFrame, duration: float) -> DataFrame:
    """Area and increase per well of the dye rescaled per experiment."""
    return death.auc_and_delta(normalize.rescaled(curve, {"dead_dye_mean": "dead_dye_mean_rescaled"}, (0.0, 100.0), "exp_nr"), "dead_dye_mean_rescaled", duration)


def well_curves(organoids: DataFrame, min_length: int, duration: float) -> tuple[DataFrame, DataFrame]:
    """The whole curves and their part up to ``duration``."""
    full = death.well_curve(organoids, min_length)
    return full, full.filter(F.col("time") <= duration)
