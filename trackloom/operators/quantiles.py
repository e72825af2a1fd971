"""Exact interpolated quantiles of large groups, with little state for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000  # of the sketches: ranks are right to one part in this many


def group_quantiles(df: DataFrame, per: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(per, and a column for each name of ``wanted``: name -> (column, quantile)), interpolated between ranks as ``percentile`` does.

    ``percentile`` keeps all distinct values of a group in one task. Here a
    sketch of bounded size brackets each quantile first; a second pass counts the
    values below and at the ends of the bracket and gathers only those strictly
    inside, a few of every ACCURACY rows (all of a group of at most ten times
    ACCURACY). Nulls don't count; a group without values has a null. ``df`` is
    read twice: pass a stored table.
    """
    edge = 2.0 / ACCURACY
    brackets = []
    for name, (column, q) in wanted.items():
        ends = F.percentile_approx(F.col(column).cast("double"), F.array(F.lit(max(0.0, q - edge)), F.lit(min(1.0, q + edge))), ACCURACY)
        brackets += [ends.alias(f"_ends_{name}"), F.count(column).alias(f"_n_{name}"), F.min(F.col(column).cast("double")).alias(f"_min_{name}"), F.max(F.col(column).cast("double")).alias(f"_max_{name}")]
    first = df.groupBy(per).agg(*brackets)
    few = {n: F.col(f"_n_{n}") <= 10 * ACCURACY for n in wanted}  # a rank more or less matters there, and all values can be held
    low = {n: F.when(few[n] | F.lit(q - edge <= 0), F.col(f"_min_{n}")).otherwise(F.col(f"_ends_{n}")[0]) for n, (_, q) in wanted.items()}
    high = {n: F.when(few[n] | F.lit(q + edge >= 1), F.col(f"_max_{n}")).otherwise(F.col(f"_ends_{n}")[1]) for n, (_, q) in wanted.items()}
    first = first.select(per, *[c for n in wanted for c in (F.col(f"_n_{n}"), low[n].alias(f"_lo_{n}"), high[n].alias(f"_hi_{n}"))])
    rows = df.select(per, *sorted({c for c, _ in wanted.values()})).join(F.broadcast(first), per)  # a row for each group
    parts = []
    for n, (column, _) in wanted.items():
        v = F.col(column).cast("double")
        parts += [
            F.max(f"_n_{n}").alias(f"_n_{n}"), F.max(f"_lo_{n}").alias(f"_lo_{n}"), F.max(f"_hi_{n}").alias(f"_hi_{n}"),
            F.count_if(v < F.col(f"_lo_{n}")).alias(f"_below_{n}"), F.count_if(v == F.col(f"_lo_{n}")).alias(f"_at_{n}"),
            F.sort_array(F.collect_list(F.when((v > F.col(f"_lo_{n}")) & (v < F.col(f"_hi_{n}")), v))).alias(f"_in_{n}"),
        ]
    second = rows.groupBy(per).agg(*parts)
    return second.select(per, *[_interpolated(n, q).alias(n) for n, (_, q) in wanted.items()])


def _interpolated(n: str, q: float) -> Column:
    place = F.lit(q) * (F.col(f"_n_{n}") - 1)
    rank = F.floor(place)

    def value(r: Column) -> Column:
        inside = r - F.col(f"_below_{n}") - F.col(f"_at_{n}")
        found = F.try_element_at(F.col(f"_in_{n}"), (inside + 1).cast("int"))
        return F.when(inside < 0, F.col(f"_lo_{n}")).when(inside >= F.size(f"_in_{n}"), F.col(f"_hi_{n}")).otherwise(found)

    lower, upper = value(rank), value(F.ceil(place))
    return F.when(F.col(f"_n_{n}") > 0, lower + (place - rank) * (upper - lower))
