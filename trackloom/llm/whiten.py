"""Whitening of embeddings on their leading principal components.

Vectors become whole numbers, each different one counts once, and the leading
eigenvectors of their covariance come from subspace iteration: a block of
vectors is filtered by a Chebyshev polynomial of the covariance, which damps the
spectrum below the block, then orthogonalised and turned by Rayleigh-Ritz, until
the residuals certify it. The covariance is never formed: each step is one pass
over the distributed rows that adds up X'(XQ) of the centred rows of each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.rows import quoted
from trackloom.llm.store import stored

COMPONENTS = 4
SCALE = 256
BLOCK = 16  # vectors iterated at least; more than are wanted, for a gap
DEGREE = 14  # of the polynomial
ROUNDS = 200
CERTIFIED = 1e-12  # residual, as a share of the largest eigenvalue
LANES = 16  # partial sums that reach the driver
_SAFE = 1 << 62


@dataclass
class Centre:
    """n rows with exact column sums; rows are centred on the nearest whole number first, so that nothing is lost."""

    n: int
    sums: list[int]
    reach: int  # largest distance of an entry from its column's ``shift``

    @property
    def shift(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def left(self) -> list[int]:
        """n times what the shift leaves of each mean."""
        return [s - self.n * h for s, h in zip(self.sums, self.shift, strict=True)]

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """x - shift, as int64 where that fits and else as Python's whole numbers."""
        shift = self.shift
        if self.reach < _SAFE and all(abs(h) < _SAFE for h in shift):
            return x - np.array(shift, dtype=np.int64)
        return x.astype(object) - np.array(shift, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.shifted(x).astype(np.float64) - np.array([float(r) / self.n for r in self.left])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None where it fits no 64-bit number."""
        y, left = self.shifted(x), self.left
        largest = self.n * (self.reach + 1) + self.n
        if y.dtype == np.int64 and x.shape[1] * largest * largest < 2 * _SAFE:
            each = self.n * y - np.array(left, dtype=np.int64)
            return (each * each).sum(axis=1).tolist()
        each = self.n * y.astype(object) - np.array(left, dtype=object)
        return [v if v < 2 * _SAFE else None for v in (each * each).sum(axis=1).tolist()]


def whole_vectors(vectors: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """The rows that take part with ``_x``, array<bigint>: floor(scale * entry), saturated, padded with zeros to the longest vector."""
    v = F.col(quoted(vector_col))
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(good)
    dim = rows.agg(F.max(F.size(v))).first()[0] or 0
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return rows.withColumn("_x", F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size(v))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: rows of one array column -> for each dimension their number, exact sum, least and largest entry."""
    n, total, low, high = 0, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(0))
        lo, hi = x.min(axis=0), x.max(axis=0)
        exact = max(abs(int(lo.min(initial=0))), abs(int(hi.max(initial=0)))) * len(x) < _SAFE
        part = (x if exact else x.astype(object)).sum(axis=0).tolist()
        n += len(x)
        total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    if n:
        d = len(total)
        columns = [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(low), pa.array(high)]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "n", "s", "low", "high"])


def centre_of(rows: DataFrame) -> Centre | None:
    """Number and column sums of ``rows`` (one array column); None of no rows or no columns. A row for each dimension reaches the driver."""
    found = rows.mapInArrow(_sums, "dim int, n bigint, s decimal(38,0), low bigint, high bigint").groupBy("dim")
    got = found.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    if not got:
        return None
    centre = Centre(got[0]["n"], [int(r["s"]) for r in got], 0)
    centre.reach = max(max(abs(r["low"] - h), abs(r["high"] - h)) for r, h in zip(got, centre.shift, strict=True))
    return centre


def _added(table: pa.Table) -> pa.Table:
    """applyInArrow body: the partial sums of a lane, added up."""
    total = np.sum([np.frombuffer(b.as_py(), np.float64) for b in table["body"]], axis=0)
    return pa.table({"body": pa.array([total.tobytes()], pa.binary())})


def _pass(rows: DataFrame, centre: Centre, product, size: int) -> np.ndarray:
    """The sum of ``product(centred rows)``, an array of ``size`` doubles, over all rows; LANES partial sums reach the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += product(centre.centred(_matrix(batch.column(0)))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["body"])

    parts = rows.mapInArrow(run, "body binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    return np.sum([np.frombuffer(r["body"], np.float64) for r in parts.groupBy("lane").applyInArrow(_added, "body binary").collect()], axis=0)


def leading_eigenvectors(apply, dim: int, wanted: int, *, block: int = BLOCK, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (dim, wanted) of a symmetric positive operator given by ``apply(Q) -> AQ``.

    Each round filters the block by the scaled Chebyshev recurrence, which keeps
    small what lies between 0 and the least Ritz value, orthogonalises it, and
    turns it by Rayleigh-Ritz. It ends when the residuals of all wanted vectors
    are below CERTIFIED times the largest eigenvalue and no longer fall; an error
    says so if that is not reached.
    """
    wanted = min(wanted, dim)
    block = min(dim, max(block, 4 * wanted))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, block)))[0]
    before = np.inf
    for _ in range(rounds):
        w = apply(q)
        h = q.T @ w
        value, turn = np.linalg.eigh((h + h.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        top = max(value[0], np.finfo(float).tiny)
        worst = np.linalg.norm(w[:, :wanted] - q[:, :wanted] * value[:wanted], axis=0).max() / top
        if worst <= CERTIFIED and (worst <= 1e-15 or worst > before / 2):
            found = q[:, :wanted]
            largest = found[np.argmax(np.abs(found), axis=0), np.arange(wanted)]
            return value[:wanted], found * np.where(largest < 0, -1.0, 1.0)  # one of both signs, so that reruns agree
        before = worst
        half = max(value[-1], 1e-6 * top) / 2  # centre and half width of what is damped
        scale = half / (top - half)
        tau, old = 2 / scale, q
        now = (w - half * q) * (scale / half)
        for _ in range(degree - 1):
            next_scale = 1 / (tau - scale)
            now, old = (apply(now) - half * now) * (2 * next_scale / half) - (scale * next_scale) * old, now
            scale = next_scale
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"eigenvectors not certified: residual {before:.1e} after {rounds} rounds")


@dataclass
class Whitening:
    """What ``fit`` learned: ``vectors`` has a unit eigenvector in each column, ``values`` their eigenvalues."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of the rows of ``fit_list`` (one column, array<bigint>, all of one length), which is read once for each step.

    Components without variance (below 1e-12 of all) are left out; None if none is left.
    """
    centre = centre_of(fit_list)
    if centre is None:
        return None
    dim, n = len(centre.sums), centre.n
    trace = float(_pass(fit_list, centre, lambda y: np.array([(y * y).sum()]), 1)[0]) / n
    if not trace > 0:
        return None
    apply = lambda q: _pass(fit_list, centre, lambda y: y.T @ (y @ q), q.size).reshape(q.shape) / n
    values, vectors = leading_eigenvectors(apply, dim, components)
    kept = values > 1e-12 * trace
    model = Whitening(centre, values[kept], vectors[:, kept], trace, 0.0)
    white, k = model.projection, int(kept.sum())
    cov = _pass(fit_list, centre, lambda y: (y @ white).T @ (y @ white), k * k).reshape(k, k) / n
    model.identity_error = float(np.abs(cov - np.eye(k)).max())
    return model


def _project(batches, model: Whitening):
    """mapInArrow body: (id, x) -> a row for each component."""
    k = len(model.values)
    explained = model.values / model.trace
    for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
        x = _matrix(batch.column(1))
        n = len(x)
        each = np.repeat(np.arange(n), k)
        columns = [
            batch.column(0).take(pa.array(each)),
            pa.array(np.tile(np.arange(1, k + 1), n).astype(np.int32)),
            pa.array(np.full(n * k, model.centre.n, np.int64)),
            pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(each)),
            pa.array((model.centre.centred(x) @ model.projection).ravel()),
            pa.array(np.tile(explained, n)),
            pa.array(np.full(n * k, model.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Rows whose vector is null or holds null or non-finite entries are left out;
    all others stay, repeated ids and null ids too. Entries become
    floor(scale * entry), beyond 64 bits the largest such number. A vector
    shorter than the longest counts as having zeros there. Equal vectors count
    once in the fit. Components without variance are left out, so equal vectors
    only, or a single one, give no rows. ``deviation`` is null where it exceeds
    64 bits. Other columns are ignored.
    """
    rows = whole_vectors(vectors.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(vector_col)).alias("_v")), "_v", scale).select("_id", "_x")
    fit_list = stored(rows.select("_x").distinct(), "fit-list")
    model = fit(fit_list, components)
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return rows.mapInArrow(lambda it: _project(it, model), schema).withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
