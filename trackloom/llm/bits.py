"""Bit filters of fixed size: which keys may be in a set of any size, and which may occur how often.

More keys only set more bits, so more rows pass to the exact step behind a
filter; no row that matters is ever lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.store import small_batches

FILTER_BITS = 1 << 24  # 2 MB
PACKED_HASHES = 1 << 20  # hashes that a task packs at a time
FREQUENCY_LOG2 = 25  # 2**25 bits for the first level (4 MB), half as many for each further one, as fewer hashes reach it


def bit_filter(keys: DataFrame, column: str) -> Broadcast:
    """Broadcast bit filter over the low bits of well-mixed 64-bit ``column``, put together on the executors."""
    words = keys.selectExpr(f"({column} & {FILTER_BITS - 1}) >> 6 AS at", f"shiftleft(1L, CAST({column} & 63 AS INT)) AS b").groupBy("at").agg(F.bit_or("b").alias("b"))
    table = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    got = words.toPandas()
    table[got["at"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_contain(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which uint64 values may be among the keys."""
    bit = values & np.uint64(FILTER_BITS - 1)
    return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def passes(shared: Broadcast, column: Column) -> Column:
    @F.arrow_udf("boolean")
    def check(values: pa.Array) -> pa.Array:
        return pa.array(may_contain(shared.value, values.to_numpy().view(np.uint64)))

    return check(column)


def _buckets(batches, hashes, log2):
    """mapInArrow body: text -> for each range of hashes the next 32 bits of the hashes in it, packed."""

    def packed(found):
        hash_ = np.concatenate(found)
        bucket = (hash_ >> np.uint64(64 - log2)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        rest = (hash_[order] >> np.uint64(32 - log2)).astype(np.uint32)
        present, first = np.unique(bucket[order], return_index=True)
        cut = np.append(first, len(rest))
        rows = [rest[cut[i] : cut[i + 1]].tobytes() for i in range(len(present))]
        return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "hashes"])

    found, size = [], 0
    for batch in batches:
        for _, data, offsets in tx.text_chunks(batch.column(0)):
            found.append(hashes(data, offsets))
            size += len(found[-1])
            if size >= PACKED_HASHES:
                yield packed(found)
                found, size = [], 0
    if found:
        yield packed(found)


def _level_bits(size: int, level: int, log2: int) -> int:
    """log2 of the bits of a level's filter; each range of hashes has whole bytes of it."""
    return max(size - level, log2 + 3)


def _slices(levels, log2, size):
    """applyInArrow body: the hashes of a range -> its slice of each level's filter."""

    def run(table: pa.Table) -> pa.Table:
        hash_, count = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["hashes"]]), return_counts=True)
        out = []
        for n, level in enumerate(levels):
            width = _level_bits(size, n, log2) - log2
            bits = np.zeros(1 << width, dtype=bool)
            bits[(hash_ >> np.uint32(32 - width))[count >= level]] = True
            out.append(np.packbits(bits, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(levels), pa.int32()), "level": pa.array(range(len(levels)), pa.int32()), "bits": pa.array(out, pa.binary())})

    return run


def hash_ranges(spark) -> int:
    """log2 of the number of hash ranges: about four ranges to a shuffle partition."""
    return max(4, min(15, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1))


def frequency_filters(texts: DataFrame, hashes, levels: tuple[int, ...], size: int = FREQUENCY_LOG2) -> Broadcast:
    """Broadcast filters: which hashes occur at least ``levels[i]`` times in all of ``texts`` (one string column).

    hashes(data, offsets) gives the well-mixed hashes of a chunk of texts. Counts
    are exact for the leading bits that are shuffled (4 bytes a hash). The first
    level takes 2**size bits, each further one half of that.
    """
    spark = texts.sparkSession
    log2 = hash_ranges(spark)
    packed = texts.mapInArrow(lambda it: _buckets(it, hashes, log2), "bucket int, hashes binary")
    tables = [np.zeros(1 << (_level_bits(size, n, log2) - 3), dtype=np.uint8) for n in range(len(levels))]
    with small_batches(spark):
        got = packed.groupBy("bucket").applyInArrow(_slices(levels, log2, size), "bucket int, level int, bits binary").toArrow()
    for batch in got.to_batches():
        for bucket, level, bits in zip(*(batch.column(c) for c in ("bucket", "level", "bits")), strict=True):
            part = np.frombuffer(bits.as_buffer(), np.uint8)
            tables[level.as_py()][bucket.as_py() * len(part) : (bucket.as_py() + 1) * len(part)] = part
    del got
    return spark.sparkContext.broadcast(tables)


def frequency_level(tables: list[np.ndarray], hash_: np.ndarray) -> np.ndarray:
    """How many of the levels each hash may reach; one that misses a level reaches no later one."""
    level, open_ = np.zeros(len(hash_), dtype=np.int64), np.arange(len(hash_))
    for bits in tables:
        at = (hash_[open_] >> np.uint64(64 - (len(bits).bit_length() + 2))).astype(np.int64)
        open_ = open_[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        level[open_] += 1
    return level
