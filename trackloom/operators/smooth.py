"""Local regression of curves."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tricube_quadratic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each different x, the weighted quadratic fit there): tricube weights that reach the farthest point, a null y counts as 0.

    On either side of a point x0 the weight (1 - (d / r)^3)^3 is a polynomial in
    d = x - x0, so the sums of weighted powers of d follow from sums of powers of
    x up to x0 and in all: n log n work, where pairs would take n squared. x is
    scaled to -1..1 and sums are kept in extended precision, as differences of
    high powers lose digits. NaN where fewer than three different points have a
    weight.
    """
    order = np.argsort(x, kind="stable")
    x, y = x[order], np.nan_to_num(y[order])
    at, first = np.unique(x, return_index=True)
    out = np.full(len(at), np.nan)
    low, high = x[0], x[-1]
    if not high > low:
        return at, out
    middle, half = (np.longdouble(low) + high) / 2, (np.longdouble(high) - low) / 2
    u = (x.astype(np.longdouble) - middle) / half
    u0 = (at.astype(np.longdouble) - middle) / half
    upto = np.append(first[1:], len(x))  # points at x0 count to the left, where their d is 0
    power = u ** np.arange(14)[:, None]
    sums = [np.concatenate([np.zeros((14, 1), np.longdouble), np.cumsum(v, axis=1)], axis=1) for v in (power, power * y)]
    reach = 1 + np.abs(u0)

    def moment(which: int, k: int) -> np.ndarray:
        """Sum of w d^k, times y if ``which`` is 1."""
        left = sums[which][:, upto]
        right = sums[which][:, -1:] - left
        total = np.zeros(len(at), np.longdouble)
        for m in range(4):
            p = 3 * m + k
            shifted = [sum(comb(p, q) * (-u0) ** (p - q) * side[q] for q in range(p + 1)) for side in (left, right)]
            total += comb(3, m) * (-1) ** m / reach ** (3 * m) * ((-1) ** m * shifted[0] + shifted[1])
        return total

    s, t = [moment(0, k) for k in range(5)], [moment(1, k) for k in range(3)]
    det = lambda a, b, c: a * (s[2] * s[4] - s[3] * s[3]) - s[1] * (b * s[4] - s[3] * c) + s[2] * (b * s[3] - s[2] * c)
    weighted = len(at) - (at - low >= high - at).astype(int) - (high - at >= at - low).astype(int)  # the farthest point has none
    enough = weighted >= 3
    out[enough] = (det(*t) / np.where(enough, det(*s[:3]), 1)).astype(np.float64)[enough]
    return at, out


def local_quadratic(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """``smooth``: at each point of a group's curve the weighted quadratic fit over the whole group (span 1, tricube weights).

    A task fits one curve at a time; see ``tricube_quadratic``. Null where the
    curve has too few points, or at a null x.
    """
    kind, x_type = df.select(*group).schema, df.schema[x].dataType
    renamed = [f"_g{i}" for i in range(len(group))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(group, renamed, strict=True)], F.col(x).alias("_x"), F.col(y).cast("double").alias("_y"))

    def fit(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_valid(table["_x"]))
        at, smooth = np.zeros(0), np.zeros(0)
        if len(known):
            places = known["_x"].to_numpy().astype(np.float64)
            at, smooth = tricube_quadratic(places, known["_y"].to_numpy(zero_copy_only=False).astype(np.float64))
        n, extra = len(at), int(len(known) < len(table))
        columns = [pa.concat_arrays([pa.array([table[c][0].as_py()], table.schema.field(c).type)] * (n + extra)) if n + extra else pa.array([], table.schema.field(c).type) for c in renamed]
        fitted = pa.array(np.append(smooth, [np.nan] * extra), from_pandas=True)
        return pa.table([*columns, pa.array([*at.tolist(), *[None] * extra], pa.float64()).cast(table.schema.field("_x").type), fitted], names=[*renamed, "_x", "smooth"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(renamed, kind, strict=True))
    out = rows.groupBy(*renamed).applyInArrow(fit, f"{fields}, _x {x_type.simpleString()}, smooth double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(renamed, group, strict=True)], F.col("_x").alias(x), "smooth")
