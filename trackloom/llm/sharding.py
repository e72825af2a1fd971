"""Sharding by jump consistent hashing: a key and the number of shards decide, with no ring table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.prefix import hash_key, with_running_sum
from trackloom.llm.rows import quoted, restored, whole_row
from trackloom.llm.store import stored


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach, 2014): all keys leap together until each would leave the range."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    leap = np.zeros(len(state), dtype=np.float64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = leap[live].astype(np.int64)
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        leap[live] = np.floor((shard[live] + 1) * (2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)))
        live = live[leap[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a hexadecimal key (its first 16 digits count)."""

    @F.arrow_udf("int")
    def jump(high: pa.Array, low: pa.Array) -> pa.Array:
        keys = (high.to_numpy().astype(np.uint64) << np.uint64(32)) | low.to_numpy().astype(np.uint64)
        return pa.array(jump_hash(keys, shards).astype(np.int32))

    part = lambda at: F.conv(F.substring(key, at, 8), 16, 10).cast("bigint")
    return jump(part(1), part(9))


def shard_documents(documents: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_key, size, text_crc32, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards decide; with one shard
    more (grown_shard), rows move into the new one only. slot counts the rows of
    a shard from 0 in order of the hashed id. A null or empty text has size 1
    and CRC 0; null ids share one key; rows that repeat share a shard and have
    slots of their own. Columns other than the named ones are ignored.
    """
    body = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keyed = documents.select(F.col(quoted(id_col)).alias("id"), hash_key(id_col).alias("hkey"), (F.octet_length(body).cast("bigint") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.md5(body).alias("text_key"))
    keyed = stored(keyed.withColumns({"shard": shard_of(F.col("hkey"), shards), "grown_shard": shard_of(F.col("hkey"), shards + 1), "one": F.lit(1).cast("bigint")}), "keyed")
    placed = with_running_sum(keyed, "shard", "hkey", "one", ["id", "size", "text_key"])
    return placed.select(F.col("id").alias(id_col), "text_key", "size", "text_crc32", "shard", F.col("before").alias("slot"), "grown_shard")


def with_shards(documents: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, and ``shard`` and ``slot`` as in ``shard_documents``; pass a stored table.

    Of a column that has one of these two names already, the value becomes the
    new one (as with ``withColumn``); all other names may occur.
    """
    kept = [c for c in documents.columns if c.lower() not in ("shard", "slot")]
    body = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keyed = documents.select(
        whole_row(documents.select(*[quoted(c) for c in kept])).alias("carried"), F.col(quoted(id_col)).alias("id"), hash_key(id_col).alias("hkey"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"), F.md5(body).alias("text_key"), F.lit(1).cast("bigint").alias("one"),
    )
    placed = with_running_sum(keyed.withColumn("shard", shard_of(F.col("hkey"), shards)), "shard", "hkey", "one", ["id", "size", "text_key"], out="slot")
    return restored(placed, "carried", "shard", "slot")


def write_shards(documents: DataFrame, path: str, shards: int, *, id_col: str = "doc_id") -> None:
    """Write the rows into folders ``shard=0`` .. of Parquet files, several writers to a shard; a column ``shard`` of the table is replaced."""
    keyed = documents.withColumn("shard", shard_of(hash_key(id_col), shards))
    keyed.repartition("shard", F.substring(hash_key(id_col), -2, 2)).write.partitionBy("shard").parquet(path)


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
