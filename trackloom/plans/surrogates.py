"""Views of the generic tables in the shape of tracking data, with the same views as SQL.

``cells``: events per user and day as a moving cell; ``fragments``: line items
per supplier and month as an organoid in pieces; ``points``: the first three
dimensions of embeddings. Sums are of whole hundredths, so they are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.death import merge_fragments

TCELL_DURATION, TCELL_MIN, TCELL_MAX = 28, 20, 25
CELL_DISTANCE, ORGANOID_DISTANCE, CELL_DYE = 0.25, 6.0, 130.0
ORGANOID_DURATION, ORGANOID_MIN, ORGANOID_DYE, ORGANOID_VOLUME = 60, 80, 18.0, 50.0


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).alias("time"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
    e = e.groupBy("user_id", "time").agg((F.sum("c").cast("double") / F.count("c") / 100).alias("speed"), (F.max("c").cast("double") / 100).alias("displacement"), (F.sum("c").cast("double") / 100).alias("red_lym"), (F.min("c").cast("double") / 100).alias("dist_org"))
    user = F.col("user_id")
    return e.select(
        user.cast("string").alias("track_id"), user.alias("number"), F.col("time").cast("int").alias("time"), "speed", "displacement", "red_lym", "dist_org", (user % 3).cast("int").alias("exp_nr"),
        F.concat(F.lit("well"), (user % 2).cast("string")).alias("well"), F.when(user % 2 == 1, "CD8").otherwise("CD4").alias("tcell_line"), F.concat(F.lit("L"), (user % 4).cast("string")).alias("organoid_line"),
    )


CELLS = """
cells AS (SELECT CAST(user_id AS VARCHAR) AS track_id, user_id AS number, CAST(time AS INTEGER) AS time, CAST(s AS DOUBLE) / n / 100 AS speed, CAST(hi AS DOUBLE) / 100 AS displacement, CAST(s AS DOUBLE) / 100 AS red_lym, CAST(lo AS DOUBLE) / 100 AS dist_org,
  CAST(user_id % 3 AS INTEGER) AS exp_nr, 'well' || (user_id % 2) AS well, CASE WHEN user_id % 2 = 1 THEN 'CD8' ELSE 'CD4' END AS tcell_line, 'L' || (user_id % 4) AS organoid_line
  FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS time, CAST(sum(c) AS BIGINT) AS s, count(c) AS n, max(c) AS hi, min(c) AS lo FROM (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1, 2))
"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    l = read("lineitem").join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))  # noqa: E741
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    return l.select(
        F.col("l_suppkey").cast("string").alias("track_id"), month.cast("int").alias("time"), F.col("r_name").alias("organoid_line"), F.when(F.col("s_nationkey") % 2 == 1, "CD8").otherwise("CD4").alias("tcell_line"),
        (F.col("s_nationkey") % 3).cast("int").alias("exp_nr"), F.concat(F.lit("well"), (F.col("s_nationkey") % 2).cast("string")).alias("well"), F.lit("23/05/2019").alias("date"),
        F.col("l_quantity").alias("volume"), (F.round(F.col("l_discount") * 100) + month / 4).alias("dead_dye_mean"), F.round("l_extendedprice").alias("area"),
    )


FRAGMENTS = """
fragments AS (SELECT CAST(l_suppkey AS VARCHAR) AS track_id, CAST(m AS INTEGER) AS time, r_name AS organoid_line, CASE WHEN s_nationkey % 2 = 1 THEN 'CD8' ELSE 'CD4' END AS tcell_line, CAST(s_nationkey % 3 AS INTEGER) AS exp_nr, 'well' || (s_nationkey % 2) AS well, '23/05/2019' AS date,
  l_quantity AS volume, round(l_discount * 100) + m / 4 AS dead_dye_mean, round(l_extendedprice) AS area
  FROM (SELECT *, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS m FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("track_id"), "vec_id", F.col("label").alias("well"), *[v[i].cast("double").alias(a) for i, a in enumerate("xyz")])


POINTS = """
points AS (SELECT CAST(vec_id AS VARCHAR) AS track_id, vec_id, label AS well, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)
"""


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    """Embeddings as columns f0, f1, ..: all components, or the first ``dims``."""
    v = F.col("embedding")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if dims is None:
        dims = rows.agg(F.max(F.size(v))).first()[0] or 0
    return rows.select(F.col("vec_id").alias("track_id"), F.col("label").cast("string").alias("label"), *[v[i].cast("double").alias(f"f{i}") for i in range(dims)])


WELL = "organoid_line, tcell_line, exp_nr, well, date"

ORGANOIDS = (
    FRAGMENTS
    + f""", organoids AS (SELECT *, (time - 1) / 2 AS time2 FROM (SELECT track_id, time, {WELL}, sum(volume) AS volume, sum(dead_dye_mean * volume) AS dead_dye_sum, sum(area) AS area, sum(dead_dye_mean * volume) / nullif(sum(volume), 0) AS dead_dye_mean FROM fragments GROUP BY ALL) WHERE dead_dye_mean IS NOT NULL)
"""
)


def organoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_fragments(fragments(spark, sf_dir))

