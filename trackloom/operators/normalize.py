"""Normalisation per experiment: z-score, upper-quartile gate, rescaling, near-maximum division.

Experiments are few and large. Their statistics are aggregated and broadcast, a
row for each, so rows are not shuffled to one task per experiment as a window
would do; without the hint Spark may broadcast the rows of a well compressed
table instead and go on in as many tasks as there are experiments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.columns import ratio, rescale, z_score
from trackloom.operators.quantiles import group_quantiles
from trackloom.sources.tables import checkpointed

#: (upper end of the range, near-maximum quantile) with a trained model and for clustering.
MODEL, CLUSTER, SMALL_SAMPLE = (100.0, 0.9999), (1.0, 0.9999999), (1.0, 0.95)


def gated(df: DataFrame, columns: dict[str, str], settings: tuple[float, float], per: str = "exp_nr") -> DataFrame:
    """For each column -> name: the z-score where it is above its upper quartile, else its minimum, rescaled to 0..upper and divided by its near-maximum quantile."""
    upper, near_max = settings
    first = df.groupBy(per).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])
    first = first.join(group_quantiles(df, per, {f"_q_{c}": (c, 0.75) for c in columns}), per)
    out = df.join(F.broadcast(first), per)
    scaled = {}
    for c, name in columns.items():
        z = lambda v, c=c: z_score(v, f"_mean_{c}", f"_sd_{c}")
        low = z(f"_min_{c}")
        high = F.when(F.col(f"_max_{c}") > F.col(f"_q_{c}"), z(f"_max_{c}")).otherwise(low)
        scaled[name] = rescale(F.when(F.col(c) > F.col(f"_q_{c}"), z(c)).otherwise(low), low, high, (0.0, upper))
    out = out.withColumns(scaled)
    second = group_quantiles(out, per, {f"_top_{n}": (n, near_max) for n in columns.values()})
    drop = [x for x in first.columns if x != per] + [f"_top_{n}" for n in columns.values()]
    return out.join(F.broadcast(second), per).withColumns({n: ratio(n, f"_top_{n}") for n in columns.values()}).drop(*drop)


def rescaled(df: DataFrame, columns: dict[str, str], to: tuple[float, float], per: str | None = None) -> DataFrame:
    """Columns rescaled between their smallest and largest values, per group or over all rows."""
    ends = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    if per is None:  # one row of ends, as literals
        row = df.agg(*ends).first()
        out = df.withColumns({f"_{n}_{c}": F.lit(row[f"_{n}_{c}"]) for c in columns for n in ("min", "max")})
    else:
        out = df.join(F.broadcast(df.groupBy(per).agg(*ends)), per)
    scaled = out.withColumns({n: rescale(c, f"_min_{c}", f"_max_{c}", to) for c, n in columns.items()})
    return scaled.drop(*[f"_{n}_{c}" for c in columns for n in ("min", "max")])


def normalized(df: DataFrame, settings: tuple[float, float], per: str = "exp_nr") -> DataFrame:
    """q_disp, q_speed, q_red gated as above; s_contact and s_contact_lym rescaled to 0..1.

    The rows are read several times for their statistics, so they are checkpointed first.
    """
    out = gated(checkpointed(df), {"displacement": "q_disp", "speed": "q_speed", "red_lym": "q_red"}, settings, per)
    return rescaled(out, {"contact": "s_contact", "contact_lym": "s_contact_lym"}, (0.0, 1.0), per)


def active_contact(df: DataFrame, per: str = "exp_nr") -> DataFrame:
    """contact_lym set to 0 while touching an organoid, and where the mean speed is below its upper quartile of the experiment."""
    masked = df.withColumn("contact_lym", F.when(F.col("contact") == 1, F.lit(0.0)).otherwise(F.col("contact_lym").cast("double")))
    quartile = group_quantiles(masked, per, {"_quartile": ("meanspeed", 0.75)})
    return masked.join(F.broadcast(quartile), per).withColumn("contact_lym", F.when(F.col("meanspeed") < F.col("_quartile"), F.lit(0.0)).otherwise(F.col("contact_lym"))).drop("_quartile")
