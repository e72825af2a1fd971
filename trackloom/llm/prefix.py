"""Running sums over rows in hash order inside groups of any size, and over all rows in order of a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.rows import quoted
from trackloom.llm.store import stored


def group_key(column: str) -> Column:
    """A text that is never null; its byte order is the column's code point order with null last."""
    value = F.col(quoted(column)).cast("string")
    return F.concat(F.when(value.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(value, F.lit("")))


def hash_key(column: str) -> Column:
    """Hash of the column as text: 32 hexadecimal digits."""
    return F.md5(F.coalesce(F.col(quoted(column)).cast("string"), F.lit("")))


def in_buckets(df: DataFrame, group: str, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_bucket``, stored sums): the sum of ``value`` for each (group, _bucket), as ``_sum``.

    ``key`` is hexadecimal text, evenly spread. With n rows in all, every group
    is range-split by key into about sqrt(n) buckets, so a task later holds
    sqrt(n) bucket sums of a group or n_group / sqrt(n) rows of a bucket, never a
    group.
    """
    buckets = max(1, math.isqrt(df.count()))
    at = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    rows = df.withColumn("_bucket", F.shiftright(at * buckets, 32))
    return rows, stored(rows.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum")), "bucket-sums")


def running_sums(rows: DataFrame, sums: DataFrame, group: str, key: str, value: str, ties: list[str], out: str, per_group: DataFrame | None = None) -> DataFrame:
    """Adds ``out`` to the rows of ``in_buckets``: the sum of ``value`` over the rows of the group that come earlier in order of (key, *ties).

    Sums of buckets are added up first, then the rows of each bucket on their
    own. Rows meet their bucket's sum under (group, bucket), so a large group is
    spread as its buckets are. per_group: further columns of each group, added to
    the bucket sums, thus never joined with all rows of a group under one key.
    """
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    if per_group is not None:
        starts = starts.join(per_group, group)
    inside = Window.partitionBy(group, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.join(starts, [group, "_bucket"]).withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.drop("_bucket", "_start")


def with_running_sum(df: DataFrame, group: str, key: str, value: str, ties: list[str], out: str = "before") -> DataFrame:
    """``running_sums`` over a stored table, or a cheap view of one, as it is read twice.

    Null groups are not allowed; ``df`` has no columns of the names used here.
    """
    rows, sums = in_buckets(df, group, key, value)
    return running_sums(rows, sums, group, key, value, ties, out)


def running_totals(df: DataFrame, keys: list[str], totals: dict[str, str]) -> DataFrame:
    """Adds each ``out`` of totals (out -> column): the column's sum over all rows that come earlier in order of ``keys``.

    Rows are range-partitioned and summed by partition; only those sums, one row
    for each shuffle partition, are added up in one task.
    """
    parts = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in totals.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_from_{out}") for out in totals])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    added = parts.join(F.broadcast(sums), "_part").withColumns({out: F.col(f"_from_{out}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in totals.items()})
    return added.drop("_part", *[f"_from_{out}" for out in totals])
