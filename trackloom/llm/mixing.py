"""Mixing sources to target weights.

Documents get hash-random keys; within each source they are range-sorted by key
and their word counts summed up from bucket to bucket. Each source is cut where
its budget ends: whole epochs first, then the head of one more, to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.prefix import group_key, hash_key, in_buckets, running_sums, running_totals
from trackloom.llm.rows import quoted, restored, whole_row
from trackloom.llm.store import stored

MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, *, cycle: int = 3, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source from (skey, source_size): adds ``target``.

    Sources in order of skey weigh 1 .. cycle, repeating, and share the sum of
    all sizes. A target stops at max_epochs times its source's size; what is
    over goes to the others by weight, until none is above. Sorted by limit per
    weight, the sources that stop are a head of the list, so running totals over
    that order find the common level of the rest. Only the level is collected.
    """
    s = running_totals(sizes.withColumn("one", F.lit(1).cast("bigint")), ["skey"], {"rank": "one"}).drop("one")
    s = s.withColumn("weight", F.col("rank") % cycle + 1).withColumn("cap", F.col("source_size") * max_epochs)
    s = s.withColumn("need", F.col("cap") / F.col("weight")).drop("rank")
    s = stored(running_totals(s, ["need", "skey"], {"cap_before": "cap", "weight_before": "weight"}), "source-needs")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"]) - F.col("cap_before")) / (F.lit(whole["weight"]) - F.col("weight_before"))
    first = s.select("need", "skey", level.alias("level")).filter("level <= need").agg(F.min(F.struct("need", "skey", "level")).alias("f")).first()["f"]
    target = F.least(F.col("cap").cast("double"), F.lit(first["level"] if first else None).cast("double") * F.col("weight"))
    return s.select("skey", "source_size", target.alias("target"))


def _sized(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Keys and size of each row: skey, hkey, text_key, size."""
    body = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    size = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return [group_key(source_col).alias("skey"), hash_key(id_col).alias("hkey"), F.md5(body).alias("text_key"), size.alias("size")]


def _taken(rows: DataFrame, ties: list[str], cycle: int, max_epochs: int) -> DataFrame:
    """Adds source_size, target and taken to stored rows with the columns of ``_sized``."""
    rows, sums = in_buckets(rows, "skey", "hkey", "size")
    targets = source_targets(sums.groupBy("skey").agg(F.sum("_sum").alias("source_size")), cycle=cycle, max_epochs=max_epochs)
    mix = running_sums(rows, sums, "skey", "hkey", "size", ties, "before", per_group=targets)
    mix = mix.withColumn("budget", F.floor(F.col("target") + 0.5))
    mix = mix.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    head = F.least(F.greatest(F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))
    return mix.withColumn("taken", F.col("epochs") * F.col("size") + head)


def mix_sources(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: id, text_key, size, source_size, target, taken.

    size: words of the text (null and empty: 0); taken: words that the mix takes
    of the document, repeats counted. The words taken of a source are its target
    rounded to a whole number; the document in which the budget ends gives the
    words up to it. Rows that repeat are mixed as separate documents. Null ids
    share one key and are ordered by size and text; a null source is a source of
    its own, the last. Columns other than the named ones are ignored.
    """
    sized = documents.select(F.col(quoted(id_col)).alias("id"), *_sized(id_col, text_col, source_col))
    mix = _taken(stored(sized, "sized"), ["size", "text_key"], cycle, max_epochs)
    return mix.select(F.col("id").alias(id_col), "text_key", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix as documents: each row as often as it is taken, with all its columns.

    The document in which a budget ends is taken whole if half of it or more is
    due. Documents without words take no part in the budgets and stay once. Rows
    with equal id and text follow each other in order of their other columns'
    hash. A table of any column names will do, as rows are carried whole; pass a
    stored table, as it is read several times.
    """
    rows = documents.select(whole_row(documents).alias("carried"), *_sized(id_col, text_col, source_col), F.xxhash64(*[quoted(c) for c in documents.columns]).alias("tie"))
    mix = _taken(rows, ["size", "text_key", "tie"], cycle, max_epochs)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = mix.select("carried", copies.alias("copies")).filter("copies > 0")
    return restored(taken.select("carried", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS tk,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS w FROM d GROUP BY skey),
n AS (SELECT *, source_size * 3 AS cap, source_size * 3 / w AS need FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY need, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY need, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
f AS (SELECT arg_min(level, (need, skey)) AS level FROM l WHERE level <= need),
t AS (SELECT skey, source_size, least(CAST(cap AS DOUBLE), f.level * w) AS target FROM n, f),
r AS (SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY k, size, tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (skey)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e
"""
