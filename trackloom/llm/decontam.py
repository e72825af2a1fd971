"""Benchmark decontamination by winnowing.

Both sides are cut into words; of the k-grams of words only the smallest hash of
each window is kept, so that every span of ``window`` equal words shares at
least one fingerprint. Fingerprints are joined, and each hit is extended to both
sides word by word, as far as a window of equal words can reach.

Windows are ``window`` consecutive words of an item; an item with fewer words is
one window of its own length, for which a winnowing of that length runs too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.bits import bit_filter, may_contain
from trackloom.llm.rows import picked, quoted, restored, text_key
from trackloom.llm.store import stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_HITS = "array<struct<length:int,hash:bigint,context:array<string>,places:array<int>>>"
_HIT_TYPE = pa.list_(pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("context", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))]))


def _k(length: int) -> int:
    """Words in a gram: with windows of length - k + 1 grams, spans of ``length`` words share one."""
    return (length + 1) // 2


def _prints(batches, lengths, own_length, keep, pad):
    """mapInArrow body: (id column.., text) -> (id columns.., n_words, hits).

    A hit is a fingerprint with the words around it; where a text repeats them,
    it is one hit with several places, so repeated words don't multiply in the join.
    own_length: a text of fewer words than ``lengths[0]`` uses its own count (the benchmark side).
    keep: broadcast bit filter of the other side's hashes, or None.
    """
    for batch in batches:
        counts, hits = [], []
        for _, data, offsets in tx.text_chunks(batch.column(batch.num_columns - 1)):
            starts, ends, first = tx.word_spans(data, offsets, tx.ALNUM)
            words = tx.span_hash(tx.prefix_hash(data, tx.LOWER_CODE), starts, ends)
            per_text = np.diff(first)
            counts.extend(per_text.tolist())
            last = np.repeat(first[1:], per_text)
            found: list[tuple[int, int, int]] = []
            own = np.repeat(per_text, per_text)
            for length in lengths if not own_length else sorted({min(int(n), lengths[0]) for n in per_text if n}):
                grams = tx.gram_hash(words, _k(length))
                if not len(grams):
                    continue
                usable = np.arange(len(grams)) + length <= last[: len(grams)]
                if own_length and length < lengths[0]:
                    usable &= own[: len(grams)] == length
                elif own_length:
                    usable &= own[: len(grams)] >= length
                at = tx.winnow(grams, usable, length - _k(length) + 1)
                values = grams[at]
                if keep is not None:
                    known = may_contain(keep.value, values)
                    at, values = at[known], values[known]
                found.extend((int(p), length, int(v)) for p, v in zip(at, values.view(np.int64), strict=True))
            rows: list[dict] = [{} for _ in per_text]
            if found:
                text_of = np.searchsorted(first, [p for p, _, _ in found], side="right") - 1
                for (p, length, value), d in zip(found, text_of.tolist(), strict=True):
                    lo, hi, reach = int(first[d]), int(first[d + 1]), length - _k(length)
                    context = tuple(tx.LOWER[data[starts[i] : ends[i]]].tobytes().decode("utf-8", "replace") if lo <= i < hi else pad for i in range(p - reach, p + length))
                    rows[d].setdefault((length, value, context), []).append(p - lo)
            hits.extend([{"length": n, "hash": h, "context": c, "places": at} for (n, h, c), at in row.items()] for row in rows)
        ids = [batch.column(i) for i in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(counts, pa.int64()), pa.array(hits, _HIT_TYPE)], names=[*names, "n_words", "hits"])


def _exploded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode("hits").alias("h")).select(key, "h.*")


def _same_window(length: Column, at: Column) -> Column:
    return F.slice("context", at + 1, length) == F.slice("item_context", at + 1, length)


def contaminated_windows(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Scanned documents and the windows they share with items.

    Returns ``(scanned, windows)``: ``scanned`` has one row per document
    (row_key, the id, n_words, hits) and ``windows`` has distinct (row_key,
    item_id, start, length): words start .. start+length-1 of the document equal
    a window of the item.
    """
    schema = f"item_id {benchmark.schema[item_col].dataType.simpleString()}, n_words bigint, hits {_HITS}"
    items = stored(
        benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text")).mapInArrow(lambda it: _prints(it, [window], True, None, ">"), schema),
        "bench-prints",
    )
    prints = _exploded(items, "item_id").withColumnRenamed("context", "item_context").drop("places")
    lengths = sorted((r.length for r in prints.select("length").distinct().collect()), reverse=True)  # window at most
    keep = bit_filter(prints, "hash")
    id_type = documents.schema[id_col].dataType.simpleString()
    scanned = documents.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("body")).mapInArrow(lambda it: _prints(it, lengths, False, keep, "<"), f"id {id_type}, n_words bigint, hits {_HITS}")
    scanned = stored(scanned.withColumn("row_key", F.monotonically_increasing_id()), "doc-prints")
    keep.destroy()
    hits = _exploded(scanned.filter(F.size("hits") > 0), "row_key")
    pairs = hits.join(prints, ["length", "hash"])
    reach = F.col("length") - F.floor((F.col("length") + 1) / 2).cast("int")
    at = F.explode(F.filter(F.sequence(F.lit(0), reach), lambda o: _same_window(F.col("length"), o)))
    windows = pairs.select("row_key", "item_id", "length", "places", reach.alias("reach"), at.alias("o"))
    windows = windows.select("row_key", "item_id", "length", (F.col("o") - F.col("reach")).alias("shift"), F.explode("places").alias("pos"))
    windows = windows.select("row_key", "item_id", (F.col("pos") + F.col("shift")).alias("start"), "length").distinct()
    return scanned, windows


def covered_words(windows: DataFrame) -> DataFrame:
    """Words of each document that lie in any window: (row_key, n_hit)."""
    spans = windows.groupBy("row_key", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = Window.partitionBy("row_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    return spans.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row_key").agg(F.sum("fresh").cast("long").alias("n_hit"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted array of item ids as text).

    Null and empty texts have no words and no hits. Repeated rows each get their
    own row; so do rows with a null id. Items without words never occur. Words
    of an item with a null id count as hit, but the id is not listed. Columns
    other than the named ones are ignored, whatever their names.
    """
    scanned, windows = contaminated_windows(documents, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window)
    windows = stored(windows, "windows")
    items = windows.groupBy("row_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = scanned.select("row_key", "id", "n_words").join(covered_words(windows).join(items, "row_key"), "row_key", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The documents without a single hit word, with all their columns, whatever their names; null and empty texts stay."""
    marked = documents.select(F.struct(F.col(quoted(id_col)).alias("id"), text_key(text_col).alias("text_key")).alias("key"), F.col(quoted(text_col)).alias("body"))
    scanned, windows = contaminated_windows(marked, benchmark, id_col="key", text_col="body", **names)
    bad = stored(scanned.join(windows.select("row_key").distinct(), "row_key", "left_semi").select("id.*").distinct(), "contaminated")
    return restored(picked(documents, bad, id_col, text_col)[0])


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS l FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, l, list_slice(w, i, i + l - 1) AS g FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM il)),
dg AS (SELECT doc_id, i, l, list_slice(w, i, i + l - 1) AS g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM ig) WHERE len(w) >= l)),
h AS (SELECT doc_id, item_id, i, dg.l FROM dg JOIN ig ON dg.l = ig.l AND dg.g = ig.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
