"""Neighbours in space."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.numbering import numbered
from trackloom.sources.tables import checkpointed

LEAF = 32  # points of a leaf of the tree of points
FAN = 16  # nodes below a node


def _curve(place: pa.Array) -> pa.Array:
    """Place on a Z-curve: the bits of all coordinates in turn, the highest first; doubles as whole numbers of the same order, so any density is told apart."""
    values = place.flatten().to_numpy(zero_copy_only=False).reshape(len(place), -1) + 0.0  # no negative zero
    bits = np.ascontiguousarray(values).view(np.uint64)
    bits = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
    each = np.unpackbits(bits.astype(">u8").view(np.uint8).reshape(*bits.shape, 8), axis=2)  # (points, axes, 64)
    return pa.array([row.tobytes() for row in np.packbits(each.transpose(0, 2, 1).reshape(len(bits), -1), axis=1)], pa.binary())


def _from_box(axes: list[str], box: Column) -> Column:
    """Squared distance of a point from a box."""
    far = [F.greatest(box[f"lo_{a}"] - F.col(a), F.col(a) - box[f"hi_{a}"], F.lit(0.0)) for a in axes]
    return reduce(lambda x, y: x + y, [d * d for d in far])


def _nearest_in(visits: DataFrame, leaves: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(_n, _d): squared distance of each visiting point to the nearest other point of the leaf that it visits."""
    square = lambda p: reduce(lambda x, y: x + y, [(F.col(a) - p[a]) * (F.col(a) - p[a]) for a in axes])
    met = visits.join(leaves, ["_g", "_leaf"])
    others = F.filter("_points", lambda p: p[key] != F.col(key))
    return met.select("_n", F.array_min(F.transform(others, square)).alias("_d"))


def nearest_neighbour(points: DataFrame, group: list[str], key: str = "track_id", axes: list[str] | None = None, leaf: int = LEAF, fan: int = FAN, reach: float = float("inf")) -> DataFrame:
    """Distance of each point to the nearest other point of its group; infinite for a point alone.

    With ``reach`` no point looks further than that, and what is given for a point
    without a nearer neighbour is at least as far.

    Points are sorted by group and along a Z-curve and cut into leaves of at most
    ``leaf``, and these into nodes of ``fan`` each, level by level: a tree that is
    as fine as its points are dense. A point looks into its own leaf first. Then it
    goes down the tree of its group and visits the leaves whose box is nearer than
    what it has found. No cell size is needed, and no group meets itself. A point
    with a null or NaN coordinate has no neighbour and is none. ``key`` is unique
    within a group.
    """
    axes = axes or ["x", "y", "z"]
    keys = [*group, key]
    placed = reduce(lambda x, y: x & y, [F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) for a in axes])
    named = points.select(*keys, *[F.col(a).cast("double").alias(a) for a in axes])
    rows = named.filter(placed).withColumns({"_g": F.to_json(F.struct(*group)), "_z": F.arrow_udf(_curve, "binary")(F.array(*axes))})
    rows = checkpointed(numbered(rows, ["_g", "_z", key], "_n").drop("_z").withColumn("_leaf", F.floor(F.col("_n") / leaf)))
    levels = 0
    while leaf * fan**levels < rows.count():
        levels += 1
    leaves = rows.groupBy("_g", "_leaf").agg(F.collect_list(F.struct(key, *axes)).alias("_points"))
    own = _nearest_in(rows.select("_n", "_g", "_leaf", key, *axes), leaves, key, axes)
    best = rows.select("_n", "_g", F.col("_leaf").alias("_home"), key, *axes).join(own, "_n").withColumn("_best", F.least(F.coalesce("_d", F.lit(float("inf"))), F.lit((reach * (1 + 1e-9)) ** 2))).drop("_d")
    best = checkpointed(best)
    ends = [f(x).alias(n) for a in axes for f, x, n in ((F.min, f"lo_{a}", f"lo_{a}"), (F.max, f"hi_{a}", f"hi_{a}"))]
    boxes = rows.select("_g", F.col("_leaf").alias("_node"), *[F.col(a).alias(f"{end}_{a}") for a in axes for end in ("lo", "hi")]).groupBy("_g", "_node").agg(*ends)
    tree = [checkpointed(boxes)]
    for _ in range(levels):
        tree.append(checkpointed(tree[-1].withColumn("_node", F.floor(F.col("_node") / fan)).groupBy("_g", "_node").agg(*ends)))
    going = best.withColumn("_node", F.lit(0).cast("bigint"))
    for level in range(levels - 1, -1, -1):
        box = F.struct("_node", *[f"{end}_{a}" for a in axes for end in ("lo", "hi")])
        children = tree[level].groupBy("_g", F.floor(F.col("_node") / fan).alias("_node")).agg(F.collect_list(box).alias("_boxes"))
        near = F.filter("_boxes", lambda b: _from_box(axes, b) < F.col("_best"))
        going = going.join(children, ["_g", "_node"]).select(*[c for c in going.columns if c != "_node"], F.explode(F.transform(near, lambda b: b["_node"])).alias("_node"))
    found = best.select("_n", F.col("_best").alias("_d"))
    if levels:
        found = found.union(_nearest_in(going.filter("_node != _home").select("_n", "_g", F.col("_node").alias("_leaf"), key, *axes), leaves, key, axes))
    nearest = rows.select("_n", *keys).join(found.groupBy("_n").agg(F.min("_d").alias("_d")), "_n").select(*keys, F.sqrt("_d").alias("nearest"))
    return nearest.union(named.filter(~placed).select(*keys, F.lit(float("inf"))))


def within_distance(points: DataFrame, group: list[str], threshold: str, largest: float, key: str = "track_id", axes: list[str] | None = None) -> DataFrame:
    """``contact``: 1 if another point of the group is nearer than the point's own threshold, else 0.

    largest: upper bound of all thresholds, beyond which no point looks. Whether any
    point is so near is known from the nearest one, so a dense group costs no more
    than a sparse one.
    """
    keys = [*group, key]
    near = nearest_neighbour(points, group, key, axes, reach=largest)
    near = near.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(F.min("nearest").alias("_nearest"))
    same = reduce(lambda x, y: x & y, [points[c].eqNullSafe(near[f"_k{i}"]) for i, c in enumerate(keys)])
    found = points.join(near, same, "left").withColumn("contact", F.coalesce((F.col("_nearest") < F.col(threshold)).cast("int"), F.lit(0)))
    return found.select(*points.columns, "contact")
