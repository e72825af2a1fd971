"""Whole rows beside computed columns, and rows picked by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.bits import bit_filter, passes


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """The row as one struct, so that computed columns beside it clash with no name of the table; ``restored`` takes it apart."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def restored(df: DataFrame, row: str = "carried", *others: str) -> DataFrame:
    return df.select(f"{row}.*", *others)


def text_key(text_col: str) -> Column:
    """MD5 of the text; of a null, the empty string."""
    text = F.col(quoted(text_col))
    return F.when(text.isNull(), F.lit("")).otherwise(F.md5(text))


def row_key(id_: Column, key: Column) -> Column:
    """One value for an id and a text key, null ids included, on which repeated rows are dropped and then joined in one shuffle."""
    return F.concat(F.when(id_.isNull(), "-").otherwise(F.concat(F.lit("+"), id_.cast("string"))), F.lit(":"), key.cast("string"))


def picked(documents: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with) an (id, text_key) of ``keys``, each as (carried, id, text_key).

    Only rows that may be meant, by a bit filter of fixed size, go to a join;
    all others are known to be without. Null ids are compared as values.
    """
    keys = keys.select("id", "text_key").distinct()
    rows = documents.select(whole_row(documents).alias("carried"), F.col(quoted(id_col)).alias("id"), text_key(text_col).alias("text_key"))
    rows = rows.withColumn("may", passes(bit_filter(keys.select(F.xxhash64("text_key").alias("k")), "k"), F.xxhash64("text_key")))
    other = keys.select(F.col("id").alias("key_id"), F.col("text_key").alias("key_text"))
    same = F.col("id").eqNullSafe(F.col("key_id")) & (F.col("text_key") == F.col("key_text"))
    near = rows.filter("may").drop("may")
    without = rows.filter("NOT may").drop("may").union(near.join(other, same, "left_anti"))
    return without, near.join(other, same, "left_semi")
