"""Column expressions for measurements, thresholds and curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(above: Column | str, below: Column | str) -> Column:
    """Division that gives null where the divisor is zero."""
    return F.try_divide(as_column(above), as_column(below))


def z_score(value: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """Distance from the mean in standard deviations; null where there is no spread."""
    return ratio(as_column(value) - as_column(mean), sd)


def rescale(value: Column | str, low: Column | str, high: Column | str, to: tuple[float, float]) -> Column:
    """Map low..high linearly to the range ``to``; an empty range maps to its middle."""
    low, high, (start, end) = as_column(low), as_column(high), to
    inside = (as_column(value) - low) / (high - low) * (end - start) + start
    return F.when(high == low, F.lit((start + end) / 2)).otherwise(inside)


def at_most_is_contact(distance: Column | str, threshold: Column | str) -> Column:
    """1 if the distance is at most the threshold, 0 if above, null if unknown (contact with an organoid)."""
    return F.when(as_column(distance) > as_column(threshold), 0).when(as_column(distance).isNotNull() & as_column(threshold).isNotNull(), 1)


def below_is_contact(distance: Column | str, threshold: Column | str) -> Column:
    """1 if the distance is below the threshold, else 0, null if unknown (contact between cells)."""
    return (as_column(distance) < as_column(threshold)).cast("int")


def dead_flag(signal: Column | str, threshold: Column | str) -> Column:
    """0 if the dye signal is below the threshold, else 1, null if unknown."""
    return F.when(as_column(signal) < as_column(threshold), 0).when(as_column(signal).isNotNull() & as_column(threshold).isNotNull(), 1)


def hours(timepoint: Column | str, per_hour: int = 2) -> Column:
    """Hours since timepoint 1."""
    return (as_column(timepoint) - 1) / per_hour


def text_or_na(value: Column | str) -> Column:
    """The value as text, and "NA" for null, so that untracked objects keep a name."""
    return F.coalesce(as_column(value).cast("string"), F.lit("NA"))


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def without_blanks(value: Column | str) -> Column:
    """The text with its spaces removed, as file names need it."""
    return F.replace(as_column(value), F.lit(" "), F.lit(""))
