"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each codebook.
Codebooks are trained on the residuals of a bounded sample; every vector is
encoded by beam search. Codes and the lengths of what they leave over are stored
in packed blocks. A query turns into a table of inner products with all codewords,
a candidate's score is a sum of table entries, and candidates that these scores
and their bounds don't rule out are scored again on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.llm.store import stored

TRAINING_ROWS = 16384  # bound of the training sample
BOOKS, WORDS, BEAM = 32, 256, 3
BLOCK = 4096  # vectors in a packed block
QUERY_BLOCK = 1024
GROUP = 1 << 15  # candidates that a task scans for a block of queries


def train_codebooks(sample: np.ndarray, *, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """(books, words, dim): k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    out = np.zeros((books, words, sample.shape[1]), dtype=np.float32)
    for b in range(books):
        if not len(rest):
            break
        book = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = np.argmax(rest @ book.T - (book * book).sum(1) / 2, axis=1)
            count = np.bincount(near, minlength=words)
            for d in range(book.shape[1]):
                book[:, d] = np.where(count > 0, np.bincount(near, rest[:, d], words) / np.maximum(count, 1), book[:, d])
        near = np.argmax(rest @ book.T - (book * book).sum(1) / 2, axis=1)
        rest -= book[near]
        out[b] = book
    return out


def encode(vectors: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (n, books) by beam search."""
    n, dim = vectors.shape
    rest = vectors.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), dtype=np.uint8)
    for book in codebooks:
        # squared length of the residual after each codeword, for all beams of all vectors
        left = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, dim) @ book.T).reshape(n, rest.shape[1], -1) + (book * book).sum(1)
        flat = left.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        from_beam, word = best // len(book), best % len(book)
        row = np.arange(n)[:, None]
        rest = rest[row, from_beam] - book[word]
        codes = np.concatenate([codes[row, from_beam], word[:, :, None].astype(np.uint8)], axis=2)
    best = np.argmin((rest * rest).sum(2), axis=1)
    row = np.arange(n)
    return codes[row, best]


def _scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(float32 rows whose components are below 1, exponents): a row times 2**exponent is the vector."""
    exponent = np.frexp(np.abs(values).max(axis=1, initial=0))[1]
    return np.ldexp(values, -exponent[:, None]).astype(np.float32), exponent.astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _packed(batches, codebooks, block):
    """mapInArrow body: (id, vector) -> packed blocks of original vectors; with codebooks also their codes, and how far the codes' inner products may be off.

    Each vector is scaled by a power of two of its own, which is kept beside it, so
    that small ones stay what they are however large others may be. ``radii`` hold
    the length of what a code leaves over and the rounding of sums of table
    entries; a query's length times that bounds the error. ``squares`` are the
    squared lengths of the scaled vectors.
    """
    for batch in batches:
        for lo in range(0, batch.num_rows, block):
            part = batch.slice(lo, block)
            ids = part.column(0).to_numpy().astype(np.int64)
            vectors = _matrix(part.column(1))
            fields = [ids, vectors]
            if codebooks is not None:
                books = codebooks.value
                scaled, exponents = _scaled(vectors)
                codes = encode(scaled, books)
                rest, lengths = np.ldexp(vectors, -exponents[:, None]), np.zeros(len(ids))
                squares = (rest * rest).sum(axis=1)
                for b, book in enumerate(books.astype(np.float64)):
                    word = book[codes[:, b]]
                    rest -= word
                    lengths += np.linalg.norm(word, axis=1)
                radii = np.linalg.norm(rest, axis=1) + (vectors.shape[1] + len(books) + 8) * 2.0**-23 * (lengths + 1.0)
                fields += [codes, radii, squares, exponents]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in fields], names=["ids", "vectors", "codes", "radii", "squares", "exponents"][: len(fields)])


def _exact(q: np.ndarray, columns: np.ndarray, at: np.ndarray, measure: str) -> np.ndarray:
    """Scores of a query with the vectors ``at``, in double precision, added up from the first component on."""
    total = np.zeros(len(at))
    with np.errstate(over="ignore", invalid="ignore"):
        for x, column in zip(q, columns, strict=True):
            part = column.take(at)
            if measure == "l2":
                part -= x
                part *= -part
            else:
                part *= x
            total += part
    return np.where(np.isnan(total), np.inf, total)  # only where sums of opposite sign overflow


def _best(score: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest; of equal ones the first."""
    if n >= len(score):
        return np.arange(len(score))
    least = np.partition(score, len(score) - n)[len(score) - n]
    best = np.flatnonzero(score >= least)
    if len(best) > n:
        above = score[best] > least
        best = np.sort(np.concatenate([best[above], best[~above][: n - above.sum()]]))
    return best


def _scan(codebooks, measure, k, shortlist):
    """cogrouped applyInPandas body: a block of queries and a group of codes -> the k nearest of the group for each query.

    The ``shortlist`` best by code are scored on the original vectors first. The
    k-th of them is a floor: whatever the codes and their radii don't rule out
    against it is scored as well, so the result is exact, and codes that fit the
    vectors badly cost time only.
    """

    def run(asked: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        out_q, out_c, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(asked) and len(coded):
            books = codebooks.value
            words = books.reshape(-1, books.shape[2])
            joined = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in coded[c]])
            ids = joined("ids", np.int64)
            order = np.argsort(ids, kind="stable")  # candidates with equal scores are then in order of their ids
            ids, radii, squares, exponents = ids[order], joined("radii", np.float64)[order], joined("squares", np.float64)[order], joined("exponents", np.int32)[order]
            codes = np.ascontiguousarray(joined("codes", np.uint8).reshape(-1, len(books))[order].T)
            columns = np.ascontiguousarray(joined("vectors", np.float64).reshape(len(ids), -1)[order].T)
            size = np.ldexp(1.0, np.clip(exponents, -1000, 1000))  # in units of the query: nothing vanishes beside larger vectors
        for q_ids, q_body in zip(asked["q_ids"], asked["q_body"], strict=True) if len(coded) else ():
            q_ids = np.frombuffer(q_ids, np.int64)
            queries = np.frombuffer(q_body, np.float64).reshape(len(q_ids), -1)
            scaled, q_exponents = _scaled(queries)
            for n, q_id in enumerate(q_ids):
                table = (words @ scaled[n]).reshape(len(books), -1)
                length = float(np.linalg.norm(scaled[n].astype(np.float64)))
                near = table[0].take(codes[0])
                for b in range(1, len(books)):
                    near += table[b].take(codes[b])
                near, spread = near.astype(np.float64), (length + 1e-6) * radii
                with np.errstate(over="ignore", invalid="ignore"):
                    if measure == "l2":
                        ratio = np.ldexp(1.0, np.clip(exponents - q_exponents[n], -1000, 500))
                        near = (2 * near - squares * ratio) * ratio
                        spread = (2 * spread + 1e-12 * squares * ratio) * ratio + 1e-12
                    else:
                        near, spread = near * size, spread * size
                other = ids != q_id  # a query is no candidate of its own
                near[~other] = -np.inf
                first = _best(near, shortlist + 1)
                first = first[other[first]]
                score = _exact(queries[n], columns, first, measure)
                if len(score) >= k:
                    with np.errstate(over="ignore", under="ignore"):
                        floor = np.partition(score, len(score) - k)[len(score) - k]
                        floor = floor * 2.0 ** -float(q_exponents[n]) if measure == "ip" else floor * 4.0 ** -float(q_exponents[n]) + length * length
                    # not "above or equal", so that scores that overflow stay in
                    open_ = ~(near + spread < floor - 1e-9 * abs(floor)) & other
                    open_[first] = False
                    more = np.flatnonzero(open_)
                    if len(more):
                        first = np.concatenate([first, more])
                        score = np.concatenate([score, _exact(queries[n], columns, more, measure)])
                by_id = np.argsort(first, kind="stable")
                first, score = first[by_id], score[by_id]
                best = _best(score, k)
                out_q.append(np.full(len(best), q_id))
                out_c.append(ids[first[best]])
                out_s.append(score[best])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_c), "score": np.concatenate(out_s)})

    return run


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: see ``nearest``."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    usual = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return rows.filter(F.size("vector") == (usual[0]["dim"] if usual else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", measure: str = "ip", shortlist: int = 200) -> DataFrame:
    """The k nearest of ``vectors`` for each row of ``queries`` (same columns): query_id, rank, vec_id, score.

    measure ``ip`` ranks by the largest inner product, ``l2`` by the smallest
    squared distance (score: its negative); scores are computed in double
    precision on the original vectors, ties go to the smaller id. A query's own
    id is no candidate. Null ids, null, empty or zero vectors, vectors with null
    or non-finite components or of an unusual length take no part, neither as
    queries nor as candidates. Ids that repeat count once (with the smallest
    vector). With fewer candidates than k, all are returned. Other columns are
    ignored. The codes rank candidates and rule out those that cannot be among the
    k nearest, by bounds on their error; what they leave is scored exactly, so
    the result is that of a full search on any vectors.
    """
    spark = vectors.sparkSession
    base = stored(usable_vectors(vectors, id_col, vector_col), "vectors")
    asked = stored(usable_vectors(queries, id_col, vector_col), "queries")
    sample = base.orderBy(F.xxhash64("id"), "id").limit(TRAINING_ROWS).select("vector").toPandas()["vector"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    codebooks = spark.sparkContext.broadcast(train_codebooks(_scaled(np.stack(sample.to_numpy()).astype(np.float64))[0]))
    rows, cores = base.count(), spark.sparkContext.defaultParallelism
    groups = max(1, -(-rows // GROUP), min(cores, rows // BLOCK))
    lanes = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = "ids binary, vectors binary, codes binary, radii binary, squares binary, exponents binary"
    codes = base.repartition(groups, "id").mapInArrow(lambda it: _packed(it, codebooks, BLOCK), schema).withColumn("group", F.spark_partition_id())
    codes = stored(codes, "codes", batch_rows=BLOCK)
    packed = asked.repartition(lanes, "id").mapInArrow(lambda it: _packed(it, None, QUERY_BLOCK), "ids binary, vectors binary").select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_body"), F.spark_partition_id().alias("lane"))
    packed = stored(packed, "packed-queries")
    # every lane of queries meets every group of codes once, in one task
    left = packed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = codes.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    found = left.groupBy("lane", "group").cogroup(right.groupBy("lane", "group")).applyInPandas(_scan(codebooks, measure, k, shortlist), "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)
