"""Line deduplication by pairwise alignment.

Documents that overlap are found through shared rare lines. How often a line
occurs is counted over all documents and kept in bit filters of fixed size. From
every line on, the shortest run of lines with ``min_words`` words chooses its
rarest line as a key, and so does the shortest run up to every line; runs with a
line that occurs once cannot be shared and choose none. Any common block of that
many words holds such a run, so both documents have its key, and the keys in it
reach all of its lines.

Each key links the documents that have it with the first of them, so a key that
thousands of documents share makes as many links and not their square. Linked
documents are aligned by patience diff, and the blocks of at least ``min_words``
words that align are deleted from the later document. Keys that a document keeps
after that, as its lines repeat or stand in another order in the first holder,
are linked with the next holders, four times as many in each round, until they
are deleted or all earlier holders are tried: the lines deleted are those of
aligning all pairs. Copies of whole texts are linked by their digest.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.bits import bit_filter, frequency_filters, frequency_level, passes
from trackloom.llm.rows import quoted, row_key, text_key
from trackloom.llm.store import stored

MIN_WORDS = 20
LEVELS = (2, 4, 16, 64, 512)  # occurrences of a line that rarity tells apart
RETRY_GROWTH = 4  # how many times as many holders each round of retries takes

_BLOCKS = "array<struct<start:int,end:int>>"


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of lines (without the newline) and the number of each text's first line; a text that is not empty has one more line than newlines."""
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate([offsets[full], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[full + 1], breaks]), kind="stable")
    count = np.diff(np.searchsorted(breaks, offsets)) + (np.diff(offsets) > 0)
    return starts, ends, np.concatenate([[0], np.cumsum(count)])


def run_keys(lines: np.ndarray, level: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs with ``min_words`` words from and up to each line of one text, and their rarest lines.

    level: how frequent each line is, 0 for one that occurs once. A key is a
    line's hash behind its level, so the least key of a run is its rarest line
    (ties by hash); runs with a line that occurs once are left out.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(lines)
    at = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + min_words)  # first end with enough words
    begin = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    lo = np.concatenate([at[stop <= n], begin[total[1:] >= min_words]])
    hi = np.concatenate([stop[stop <= n], at[total[1:] >= min_words] + 1])
    if not len(lo):
        return lo, hi, np.zeros(0, np.uint64)
    key = np.append((level.astype(np.uint64) << np.uint64(60)) | (lines >> np.uint64(4)), np.uint64(0))
    least = np.minimum.reduceat(key, np.stack([lo, hi], axis=1).ravel())[::2]
    shared = least >> np.uint64(60) > 0
    return lo[shared], hi[shared], least[shared]


def _line_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = line_spans(data, offsets)
    return tx.span_hash(tx.prefix_hash(data), starts, ends)


def _lines(batches, min_words, filters):
    """mapInArrow body: (id, text key, digest, text) -> id, text key, digest, line hashes, words of each line, keys."""
    for batch in batches:
        hashes, words, keys = [], [], []
        for _, data, offsets in tx.text_chunks(batch.column(3)):
            starts, ends, first = line_spans(data, offsets)
            line = tx.span_hash(tx.prefix_hash(data), starts, ends)
            level = frequency_level(filters.value, line)
            word_starts, _, _ = tx.word_spans(data, offsets, tx.NOT_SPACE)
            count = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            for d in range(len(offsets) - 1):
                mine = slice(first[d], first[d + 1])
                hashes.append(line[mine].view(np.int64))
                words.append(count[mine].astype(np.int32))
                keys.append(np.unique(run_keys(line[mine], level[mine], count[mine], min_words)[2]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_key", "text_sha256", "lines", "words", "keys"]
        )


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions (i, j): equal heads and tails, then lines that are unique in both, by the longest increasing sequence, and so on in between."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a_lo, a_hi, b_lo, b_hi = todo.pop()
        while a_lo < a_hi and b_lo < b_hi and a[a_lo] == b[b_lo]:
            out.append((a_lo, b_lo))
            a_lo, b_lo = a_lo + 1, b_lo + 1
        while a_lo < a_hi and b_lo < b_hi and a[a_hi - 1] == b[b_hi - 1]:
            a_hi, b_hi = a_hi - 1, b_hi - 1
            out.append((a_hi, b_hi))
        if a_lo == a_hi or b_lo == b_hi:
            continue
        once_a, once_b = _once(a, a_lo, a_hi), _once(b, b_lo, b_hi)
        common = sorted((i, once_b[x]) for x, i in once_a.items() if x in once_b)
        chain = _longest_increasing(common)
        if not chain:
            continue
        out += chain
        edges = [(a_lo - 1, b_lo - 1), *chain, (a_hi, b_hi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


def _once(lines: list, lo: int, hi: int) -> dict:
    seen: dict = {}
    for i in range(lo, hi):
        seen[lines[i]] = -1 if lines[i] in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tops, at, back = [], [], [None] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[n] = at[p - 1] if p else None
        if p == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[p], at[p] = j, n
    chain, n = [], at[-1] if at else None
    while n is not None:
        chain.append(pairs[n])
        n = back[n]
    return chain[::-1]


def common_blocks(a: list, b: list, words_b: list, min_words: int) -> list[tuple[int, int]]:
    """Line ranges [start, end) of ``b`` that align with ``a`` line after line and have ``min_words`` words."""
    blocks, pairs = [], patience(a, b)
    start = 0
    for n in range(1, len(pairs) + 1):
        if n == len(pairs) or pairs[n] != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
            lo, hi = pairs[start][1], pairs[n - 1][1] + 1
            if sum(words_b[lo:hi]) >= min_words:
                blocks.append((lo, hi))
            start = n
    return blocks


def _aligned(batches, min_words):
    """mapInArrow body: (row, lines of the earlier, lines and words of the later document) -> row, blocks of the later one."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out = []
        for a, b, words in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            out.append([{"start": lo, "end": hi} for lo, hi in common_blocks(a, b, words, min_words)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["row", "blocks"])


def _kept_keys(batches, min_words, filters):
    """mapInArrow body: (row, lines, words, blocks) -> row, keys of the runs of which a line is kept."""
    for batch in batches:
        keys = []
        for line, words, blocks in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
            hash_ = np.asarray(line.values).view(np.uint64)
            lo, hi, key = run_keys(hash_, frequency_level(filters.value, hash_), np.asarray(words.values), min_words)
            gone = np.zeros(len(line) + 1, dtype=np.int64)
            for b in blocks.as_py() or ():
                gone[b["start"] + 1 : b["end"] + 1] = 1
            gone = np.cumsum(gone)
            keys.append(np.unique(key[gone[hi] - gone[lo] < hi - lo]).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["row", "keys"])


def _align(links: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Links (row, first) -> (row, blocks), stored; rows without blocks are left out."""
    pairs = links.join(lines.select("row", F.col("lines").alias("later"), "words"), "row").join(lines.select(F.col("row").alias("first"), F.col("lines").alias("earlier")), "first")
    blocks = pairs.select("row", "earlier", "later", "words").mapInArrow(lambda it: _aligned(it, min_words), f"row bigint, blocks {_BLOCKS}")
    return stored(_merged(blocks.filter(F.size("blocks") > 0)), "blocks")


def _merged(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))


def _retried(lines: DataFrame, links: DataFrame, blocks: DataFrame, copies: DataFrame, min_words: int, filters: Broadcast) -> DataFrame:
    """Blocks of all rounds: (row, blocks). ``copies`` (rows that equal an earlier one) are no holders, as they align as their first does."""

    def kept(rows: DataFrame) -> DataFrame:
        found = rows.join(lines.select("row", "lines", "words"), "row").join(blocks, "row", "left").select("row", "lines", "words", "blocks")
        return found.mapInArrow(lambda it: _kept_keys(it, min_words, filters), "row bigint, keys array<bigint>").select("row", F.explode("keys").alias("key"))

    open_ = stored(kept(links.select("row").distinct().join(copies, "row", "left_anti")), "kept-keys")
    order = Window.partitionBy("key").orderBy(F.col("id").isNull(), "id", "row")
    held = lines.select("row", "id", F.explode("keys").alias("key")).join(open_.select("key").distinct(), "key", "left_semi").join(copies, "row", "left_anti")
    held = stored(held.select("key", "row", F.row_number().over(order).alias("rank")), "holders")
    open_ = stored(open_.join(held, ["row", "key"]).filter("rank > 2"), "open-keys")
    done, size = 1, RETRY_GROWTH  # the first holder of each key has been tried
    while open_.head(1):
        holders = held.filter((F.col("rank") > done) & (F.col("rank") <= done + size)).select("key", F.col("row").alias("first"), F.col("rank").alias("at"))
        tries = stored(open_.join(holders, "key").filter("at < rank").select("row", "first").distinct().join(links, ["row", "first"], "left_anti"), "line-links")
        links = links.union(tries)
        blocks = stored(_merged(blocks.union(_align(tries, lines, min_words))), "blocks")
        done, size = done + size, size * RETRY_GROWTH
        left = open_.filter(F.col("rank") > done + 1)
        open_ = stored(left.join(kept(left.select("row").distinct()), ["row", "key"], "left_semi"), "open-keys")
    return blocks


def repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: row, id, text_key, text_sha256, n_lines, blocks (array of line ranges to delete; they may overlap).

    Lines end at newlines and are compared byte by byte. The earlier document is
    the one with the smaller id; null ids come last and rows that share an id
    follow in the order in which they are read, so of rows that repeat the first
    stays. Null and empty texts have no lines. Repeats inside one document stay.
    The lines deleted are those of aligning each document with all earlier ones.
    Columns other than the named ones are ignored.
    """
    body = F.col(quoted(text_col))
    keyed = documents.select(F.col(quoted(id_col)).alias("id"), text_key(text_col).alias("text_key"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("text_sha256"), body.alias("body"))
    id_type = keyed.schema["id"].dataType.simpleString()
    filters = frequency_filters(keyed.select("body"), _line_hashes, LEVELS)
    lines = keyed.mapInArrow(lambda it: _lines(it, min_words, filters), f"id {id_type}, text_key string, text_sha256 string, lines array<bigint>, words array<int>, keys array<bigint>")
    lines = stored(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    keys = lines.select("row", "id", F.explode("keys").alias("key"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    holders = keys.groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("documents")).filter("documents > 1").select("key", F.col("first.row").alias("first"))
    links = keys.join(holders, "key").filter("row != first").select("row", "first").distinct()
    equal = lines.filter(F.size("keys") > 0).groupBy("text_sha256").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("documents")).filter("documents > 1")
    equal = equal.select("text_sha256", F.col("first.row").alias("first"))
    equal = stored(lines.select("row", "text_sha256").join(equal, "text_sha256").filter("row != first").select("row", "first"), "line-copies")
    copies = equal.select("row")
    links = links.join(copies, "row", "left_anti").union(equal)
    links = stored(links, "line-links")
    blocks = _align(links, lines, min_words)
    blocks = _retried(lines, links, blocks, copies, min_words, filters)
    out = lines.select("row", "id", "text_key", "text_sha256", F.size("lines").alias("n_lines")).join(blocks, "row", "left")
    return out.select("row", F.col("id").alias(id_col), "text_key", "text_sha256", F.col("n_lines").cast("bigint").alias("n_lines"), F.coalesce("blocks", F.array().cast(_BLOCKS)).alias("blocks"))


def _deleted(line: Column) -> Column:
    return F.exists("blocks", lambda b: (line >= b["start"]) & (line < b["end"]))


def delete_lines(documents: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept) for stored rows of ``repeated_lines``: the text without its deleted lines."""
    keyed = documents.select(F.col(quoted(id_col)).alias("_id"), text_key(text_col).alias("_key"), F.col(quoted(text_col)).alias("body"))
    keyed = keyed.filter(passes(bit_filter(found.select(F.xxhash64("text_key").alias("k")), "k"), F.xxhash64("_key")))
    once = keyed.select(row_key(F.col("_id"), F.col("_key")).alias("_row"), "body").dropDuplicates(["_row"])  # of repeated rows one text
    texts = once.join(found.withColumn("_row", row_key(F.col(quoted(id_col)), F.col("text_key"))), "_row")
    kept = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: ~_deleted(i)), "\n")
    return texts.select("row", kept.alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_deleted = F.size(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("n_lines")), _deleted)).cast("bigint")
    found = repeated_lines(documents).withColumn("n_deleted", F.when(F.size("blocks") > 0, n_deleted).otherwise(F.lit(0).cast("bigint")))
    found = stored(found, "repeated-lines")
    changed = delete_lines(documents, found.filter("n_deleted > 0"))
    changed = changed.select("row", F.sha2("kept", 256).alias("sha"))
    return found.join(changed, "row", "left").select("doc_id", "n_lines", "n_deleted", F.coalesce("sha", "text_sha256").alias("kept_sha256"))
