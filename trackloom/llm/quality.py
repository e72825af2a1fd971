"""Quality classifier on supervised subword embeddings.

Words and character n-grams of words are hashed to vectors that are learned
together with a softmax output; a document is the mean of the vectors of all of
them. Pairs of words count by their shape too (another word, or the same word
again): a hashed pair is seen in too few documents to show that texts repeat
words. Training is plain stochastic gradient descent in numpy over a bounded
sample of labelled documents. As the output is linear in the mean, a trained
model is one number per hash bucket, and scoring is a table lookup per n-gram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.rows import quoted
from trackloom.llm.store import stored

BUCKETS = 1 << 16
MAX_TRAINING_ROWS = 3000  # labelled ids in the training sample
MAX_TRAINING_BYTES = 192 << 20  # of their n-grams, 6 bytes for each distinct one of a document
CHAR_GRAMS = (3, 4)
#: Buckets of the two shapes of a pair of words: another word, the same word again.
SHAPE_BUCKETS = (tx.mix(np.array([1, 2], dtype=np.uint64)) >> np.uint64(48)).astype(np.int32)
FOLDS = 5

#: Bits of the first four bytes that belong to a character, by its first byte.
_CHAR_MASK = np.full(256, 0xFF, dtype=np.uint32)
_CHAR_MASK[0xC0:0xE0], _CHAR_MASK[0xE0:0xF0], _CHAR_MASK[0xF0:] = 0xFFFF, 0xFFFFFF, 0xFFFFFFFF
#: All whitespace counts as one character, which marks the ends of a word.
_SAME_SPACE = np.where(tx.NOT_SPACE, np.arange(256), 0x20).astype(np.uint8)


def held_out(id_col: str) -> Column:
    """True for rows that never train: crc32 of the id as text is divisible by FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(quoted(id_col)).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def _bucket(values: np.ndarray) -> np.ndarray:
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 characters of a chunk as numbers (whitespace as one), which of them are whitespace, and the number of each text's first."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.concatenate([_SAME_SPACE[data], np.zeros(3, np.uint8)]).astype(np.uint32)
    code = padded[at]
    for j in range(1, 4):
        code = code | (padded[at + j] << np.uint32(8 * j))
    code &= _CHAR_MASK[data[at]]
    return code, code == 0x20, np.searchsorted(at, offsets)


def character_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offset of each text) of the n-grams of characters inside words; a word has the space before and after it as its ends."""
    code, space, first = characters(data, offsets)
    count = max(len(code) - n + 1, 0)
    gram = np.full(count, n, dtype=np.uint32)
    for j in range(n):
        gram = gram * np.uint32(0x01000193) + (code[j : j + count] ^ (code[j : j + count] >> np.uint32(15)))
    inside = np.ones(count, dtype=bool)
    for j in range(1, n - 1):
        inside &= ~space[j : j + count]
    for j in range(1, n):  # n-grams that reach into the next text
        cut = first[1:-1] - j
        inside[cut[(cut >= 0) & (cut < count)]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return _bucket(gram[inside]), kept[np.minimum(first, count)]


def _features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offset of each text): words, shapes of word pairs, n-grams of characters."""
    starts, ends, first = tx.word_spans(data, offsets, tx.NOT_SPACE)
    words = tx.span_hash(tx.prefix_hash(data), starts, ends)
    again = np.zeros(len(words), dtype=np.int32)
    again[1:] = words[1:] == words[:-1]
    again[first[:-1][np.diff(first) > 0]] = 0  # a text's first word follows none
    return [((words >> np.uint64(48)).astype(np.int32), first), (SHAPE_BUCKETS[again], first), *[character_grams(data, offsets, n) for n in CHAR_GRAMS]]


def _sparse(batches):
    """mapInArrow body: (label id, label, text) -> label id, label, distinct buckets and their shares, as bytes."""
    for batch in batches:
        buckets, shares = [], []
        for _, data, offsets in tx.text_chunks(batch.column(2)):
            parts = _features(data, offsets)
            for d in range(len(offsets) - 1):
                mine = np.concatenate([b[f[d] : f[d + 1]] for b, f in parts])
                index, count = np.unique(mine, return_counts=True)
                buckets.append(index.astype(np.uint16).tobytes())
                shares.append((count / max(len(mine), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["label_id", "label", "buckets", "shares"])


def train(labels: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], *, dim: int = 8, epochs: int = 8, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the offset, for the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    output = rng.uniform(-1 / dim, 1 / dim, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, step = max(epochs * len(texts), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            index, share = texts[i][0].astype(np.intp), texts[i][1]
            now = rate * (1 - step / steps)
            step += 1
            rows = vectors[index]
            mean = share @ rows
            logits = mean @ output + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[labels[i]] -= 1
            pull = output @ wrong
            output -= now * np.outer(mean, wrong)
            bias -= now * 0.1 * wrong
            # the mean is over many vectors, so each of them moves by the scaled share of the pull
            vectors[index] = rows - now * np.outer(np.sqrt(share), pull)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def _trained(options: dict):
    """applyInArrow body: the training rows -> the model, on an executor."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("buckets", "ascending")])  # the same order whatever task came first
        texts = [(np.frombuffer(b.as_py(), np.uint16), np.frombuffer(s.as_py(), np.float32)) for b, s in zip(table["buckets"], table["shares"], strict=True)]
        weights, offset = train(table["label"].to_numpy().astype(np.int64), texts, **options)
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "offset": [offset]})

    return run


def training_rows(labels: DataFrame, *, id_col: str, label_col: str, limit: int) -> DataFrame:
    """(label_id, label) of at most ``limit`` labelled ids that are not held out, in hash order.

    Ids that repeat count once; ids with contradicting or null labels don't count.
    """
    label = F.col(quoted(label_col))
    known = labels.filter(F.col(quoted(id_col)).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(quoted(id_col)).alias("label_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"), F.count_if(label.isNull()).alias("missing"))
    known = known.filter("label = most AND label IN (0, 1) AND missing = 0")
    return known.orderBy(F.md5(F.col("label_id").cast("string")), "label_id").limit(limit).select("label_id", F.col("label").cast("int").alias("label"))


def training_sample(documents: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, limit: int, max_bytes: int) -> DataFrame:
    """(label, buckets, shares), one row per labelled id, at most ``limit`` rows and about ``max_bytes`` bytes.

    Of an id whose rows repeat, the one whose n-grams come first counts. Whole
    texts are used; where they are too many, the ids that come last in hash order
    are left out.
    """
    sample = F.broadcast(training_rows(labels, id_col=id_col, label_col=label_col, limit=limit))  # limit rows at most
    rows = documents.select(F.col(quoted(id_col)).alias("label_id"), F.col(quoted(text_col)).alias("body")).join(sample, "label_id").select("label_id", "label", "body")
    kind = rows.schema["label_id"].dataType.simpleString()
    sparse = rows.mapInArrow(_sparse, f"label_id {kind}, label int, buckets binary, shares binary")
    once = sparse.groupBy("label_id").agg(F.min(F.struct("label", "buckets", "shares")).alias("t"))
    once = stored(once.select(F.md5(F.col("label_id").cast("string")).alias("place"), "label_id", "t.*"), "training")
    size = (3 * F.octet_length("buckets")).cast("bigint")
    upto = F.sum(size).over(Window.orderBy("place", "label_id").rowsBetween(Window.unboundedPreceding, 0))  # over limit rows at most
    fits = once.select("label_id", upto.alias("upto")).filter(F.col("upto") <= max_bytes).select("label_id")
    return once.join(F.broadcast(fits), "label_id", "left_semi").select("label", "buckets", "shares")


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES, **options) -> tuple[np.ndarray, float]:
    """Train on the documents of at most ``limit`` labelled ids; with none, every score is a half."""
    sample = training_sample(documents, labels, id_col=id_col, text_col=text_col, label_col=label_col, limit=limit, max_bytes=max_bytes)
    got = sample.groupBy(F.lit(1).alias("all")).applyInArrow(_trained(options), "weights binary, offset double").collect()  # one task: a bounded sample
    return (np.frombuffer(got[0]["weights"], np.float64), got[0]["offset"]) if got else (np.zeros(BUCKETS), 0.0)


def text_scores(column: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability of label 1 for each text."""
    weights, offset = model
    scores = np.zeros(len(column))
    for row, data, offsets in tx.text_chunks(column):
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for bucket, first in _features(data, offsets):
            sums = np.concatenate([[0.0], np.cumsum(weights[bucket])])
            total += sums[first[1:]] - sums[first[:-1]]
            count += np.diff(first)
        odds = offset + total / np.maximum(count, 1)
        scores[row : row + len(odds)] = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return scores


def score(spark: SparkSession, text_col: str, model: tuple[np.ndarray, float]) -> Column:
    """The probability of label 1 from the whole text; null and empty texts score as the offset alone."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(text_scores(texts, shared.value))

    return run(F.col(quoted(text_col)))


def good_documents(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float, *, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns, whatever their names."""
    return documents.filter(score(documents.sparkSession, text_col, model) >= threshold)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, labels)
    scored = documents.select("doc_id", held_out("doc_id").alias("held_out"), score(spark, "text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
