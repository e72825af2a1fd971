"""Per-track time series: gaps, windows, runs, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trackloom.operators.joins import natural_join
from trackloom.sources.tables import checkpointed


REPEATED = "more than one row for"


def along(track: str | list[str], time: str) -> WindowSpec:
    return Window.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(time)


def backwards(track: str | list[str], time: str) -> WindowSpec:
    """From the end of the track to the row: what is known next, in one scan. Frames that start at the row and go on to the end would be read anew for each row."""
    return Window.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, 0)


def merge_collisions(df: DataFrame, measures: list[str], track: str = "track_id", time: str = "time", *, unique: bool = False) -> DataFrame:
    """One row per track and time: the mean of each measure. With ``unique`` more than one row for a track and time fails the action, in the same aggregation."""
    merged = df.groupBy(track, time).agg(*[F.avg(c).alias(c) for c in measures], F.count(F.lit(1)).alias("_rows"))
    if unique:
        said = F.raise_error(F.concat(F.lit(f"{REPEATED} {track} "), F.coalesce(F.col(track).cast("string"), F.lit("null")), F.lit(f" at {time} "), F.coalesce(F.col(time).cast("string"), F.lit("null"))))
        merged = merged.withColumns({c: F.when(F.col("_rows") > 1, said.cast("double")).otherwise(F.col(c)) for c in measures})
    return merged.drop("_rows")


def gap_fill(df: DataFrame, measures: list[str], track: str = "track_id", time: str = "time", *, unique: bool = False) -> DataFrame:
    """Fill inner gaps by linear interpolation at every whole time that any track has.

    Nothing is made up before a track's first or after its last known value. The
    grid is each track's own span of times, cut down to the observed ones, so it
    never grows to all times by all tracks.
    """
    known = merge_collisions(df, measures, track, time, unique=unique)
    spans = known.groupBy(track).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    grid = spans.select(track, F.explode(F.sequence("_lo", "_hi")).alias(time)).join(df.select(time).distinct(), time, "left_semi")
    rows = grid.join(known, [track, time], "left")
    before, after = along(track, time).rowsBetween(Window.unboundedPreceding, 0), backwards(track, time)
    filled = {}
    for c in measures:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col(time).alias("t"), F.col(c).alias("v")))
        left, right = F.last(point, ignorenulls=True).over(before), F.last(point, ignorenulls=True).over(after)
        line = left["v"] + (right["v"] - left["v"]) * (F.col(time) - left["t"]) / (right["t"] - left["t"])
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(left.isNotNull() & right.isNotNull(), line)
    return rows.withColumns(filled).dropna(subset=measures)


def rolling_mean(df: DataFrame, measure: str, rows: int, out: str, track: str = "track_id", time: str = "time") -> DataFrame:
    """Mean over the last ``rows`` rows, null until there are as many."""
    w = along(track, time).rowsBetween(1 - rows, 0)
    return df.withColumn(out, F.when(F.count(measure).over(w) == rows, F.avg(measure).over(w)))


def carry_backward(df: DataFrame, column: str, track: str = "track_id", time: str = "time") -> DataFrame:
    """Replace nulls by the next known value of the track."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(backwards(track, time)))


def relative_time(df: DataFrame, out: str = "time2", track: str = "track_id", time: str = "time") -> DataFrame:
    """Time since the first row of the track."""
    return df.withColumn(out, F.col(time) - F.min(time).over(Window.partitionBy(track)))


def minus_first(df: DataFrame, column: str, out: str, group: list[str], time: str = "time") -> DataFrame:
    """Difference from the first value of the group in order of time."""
    first = F.first(column).over(along(group, time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.col(column) - first)


def run_length(df: DataFrame, flag: str, out: str, track: str = "track_id", time: str = "time") -> DataFrame:
    """Running count of consecutive ones, from zero again at every zero."""
    w = along(track, time).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_run", F.sum(1 - F.col(flag)).over(w))
    return run.withColumn(out, F.sum(flag).over(along([track, "_run"], time).rowsBetween(Window.unboundedPreceding, 0))).drop("_run")


def plateau(df: DataFrame, signal: str, value: str, maximum: str, track: str = "track_id", time: str = "time") -> DataFrame:
    """After the first time at which ``signal`` is largest, replace ``value`` by the track's ``maximum``."""
    whole = Window.partitionBy(track)
    top = df.withColumn("_top", F.max(signal).over(whole))
    top = top.withColumn("_peak", F.min(F.when(F.col(signal) == F.col("_top"), F.col(time))).over(whole))
    return top.withColumn(value, F.when(F.col(time) > F.col("_peak"), F.col(maximum)).otherwise(F.col(value))).drop("_top", "_peak")


def sticky(df: DataFrame, flag: str, track: str | list[str] = "track_id", time: str = "time") -> DataFrame:
    """Once the flag is 1 it stays 1 for the rest of the track."""
    return df.withColumn(flag, F.max(flag).over(along(track, time).rowsBetween(Window.unboundedPreceding, 0)))


def fill_forward(df: DataFrame, columns: list[str], scope: list[str], order: list[str]) -> DataFrame:
    """Replace nulls by the last known value before them within ``scope`` in the given order."""
    w = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def carry_forward(df: DataFrame, columns: list[str], scope: list[str], order: list[str]) -> DataFrame:
    """``fill_forward`` for scopes of any size: a scan over range partitions of (scope, order).

    Each partition fills its own rows; what it knew last of each scope, a row for
    each scope that it touches, goes on to the partitions that follow. A window
    never holds more of a scope than a partition does.
    """
    parts = checkpointed(df.repartitionByRange(*scope, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(c).alias("_v"))))["_v"]
    last = parts.groupBy("_part", *scope).agg(*[known(c).alias(f"_last{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*scope).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_part", *scope, *[F.last(f"_last{i}", ignorenulls=True).over(before).alias(f"_from{i}") for i in range(len(columns))])
    own = parts.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    filled = natural_join([own, carried], ["_part", *scope])
    return filled.select(*[F.coalesce(c, f"_from{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])


def curve_summary(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """Area under each group's curve by trapezoids (``auc``) and last minus first value (``delta``)."""
    w = along(group, x)
    strips = df.withColumn("_strip", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return strips.groupBy(*group).agg(F.coalesce(F.sum("_strip"), F.lit(0.0)).alias("auc"), (F.max_by(y, x) - F.min_by(y, x)).alias("delta"))
