"""From raw cell tracks to processed tracks, classes and shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.columns import at_most_is_contact, dead_flag
from trackloom.operators import filters, normalize, series
from trackloom.operators.ids import first_rows
from trackloom.operators.qc import FUNNEL_KEYS, funnel_by_reach

MEASURES = ["speed", "displacement", "dist_org", "red_lym", "contact_lym"]


@dataclass(frozen=True)
class Settings:
    """Bounds of the T-cell analysis; ``duration`` is inclusive in the first cut and exclusive in the second."""

    duration: float
    min_length: int
    max_length: float
    mean_rows: int = 10


def regularised(observed: DataFrame, settings: Settings, carried: list[str], *, check: bool = False) -> DataFrame:
    """Gap-filled measures, mean speed over the last rows, and the first known value of the ``carried`` columns of each track.

    Tracks shorter than ``mean_rows`` have no mean speed and go. With ``check`` a
    track with several rows at one time fails the action.
    """
    filled = series.gap_fill(observed, MEASURES, unique=check)
    filled = series.carry_backward(series.rolling_mean(filled, "speed", settings.mean_rows, "meanspeed"), "meanspeed")
    keys = first_rows(observed.select("track_id", "time", *carried), ["track_id"], ["time"]).drop("time")
    return filters.complete_rows(filled, ["meanspeed"]).join(keys, "track_id")


STAGES = ["unfiltered", "filt_exp_duration", "filt_minlength", "filt_deadcellstart"]


def _equal_parts(observed: DataFrame, settings: Settings, carried: list[str], check: bool) -> DataFrame:
    """Regularised tracks that are long enough, with relative time, cut to the same length."""
    rows = regularised(filters.until(observed, settings.duration), settings, carried, check=check).withColumn("contact", at_most_is_contact("dist_org", "organoid_contact_threshold"))
    long = filters.tracks_of_length(filters.between(rows, 0, settings.duration), settings.min_length)
    return filters.truncated(series.relative_time(long), settings.max_length)


def flagged_tracks(observed: DataFrame, settings: Settings, carried: list[str], *, check: bool = True) -> DataFrame:
    """Tracks of equal length that start alive, with flags of death and runs of contact: all of ``processed_tracks`` but the active contacts."""
    alive = filters.alive_at_start(_equal_parts(observed, settings, carried, check), F.col("tcell_dead_dye_threshold"))
    flagged = alive.withColumn("death", dead_flag("red_lym", "tcell_dead_dye_threshold"))
    return series.run_length(flagged, "contact", "contact2")


def processed_tracks(observed: DataFrame, settings: Settings, carried: list[str], *, check: bool = True) -> DataFrame:
    """Processed tracks.

    observed: one row per track and time with MEASURES and ``carried``, which
    must hold organoid_contact_threshold and tcell_dead_dye_threshold. With
    ``check`` more than one row fails the action; no job runs before it. The
    active contacts read the rows three times; where a job may run, give
    ``normalize.active_contact`` the stored ``flagged_tracks`` instead.
    """
    return normalize.active_contact(flagged_tracks(observed, settings, carried, check=check))


def track_funnel(observed: DataFrame, settings: Settings, carried: list[str], *, check: bool = True) -> DataFrame:
    """Tracks after each of STAGES per experiment and well, in one pass over the tracks.

    The first two stages count tracks under the keys of their rows, the others
    under the first keys of the track; of each only the last stage is kept.
    """
    early = observed.groupBy(*FUNNEL_KEYS, "track_id").agg(F.max(F.coalesce(F.col("time") <= settings.duration, F.lit(False)).cast("int")).alias("_reach"))
    equal = _equal_parts(observed, settings, carried, check)
    alive = (F.col("time2") == 0) & (F.col("red_lym") < F.col("tcell_dead_dye_threshold"))
    late = equal.groupBy(*FUNNEL_KEYS, "track_id").agg((F.max(F.coalesce(alive, F.lit(False)).cast("int")) + 2).alias("_reach"))
    reached = early.withColumn("_from", F.lit(0)).unionByName(late.withColumn("_from", F.lit(2)))
    return funnel_by_reach(reached.filter("track_id IS NOT NULL"), STAGES)
