"""Embedding whitening by mixed-precision eigenvectors.

An entry c becomes the integer x = floor(SCALE * c), saturating at the ends of
long. The fit list holds each distinct vector of integers once. Its covariance
comes from Spark: column sums first, then the products of the vectors less the
rounded mean, summed as integers (a float matrix product is exact below 2**53;
larger entries are split into limbs of 20 bits), so the covariance is the exact
rational rounded once, whatever the partitions.

The eigenvectors start in float32 and are corrected in double by the matrix
multiplications of Ogita and Aishima: with R = I - X'X and S = X'VX, the
correction of X is X E, where e_ij = (s_ij + l_j r_ij) / (l_j - l_i). Between
eigenvalues closer than the error of S the quotient means nothing; there only
orthogonality is restored (r_ij / 2), and the cluster is solved on its own: its
small matrix, less the middle of its eigenvalues, has the spread of the cluster
as its norm, so float32 resolves it again, recursively, down to the rounding of
the whole matrix.

What grows with the data stays in Spark. The driver gets numbers per dimension
and pairs of dimensions, never rows.

Defined results: a row whose vector is null, empty, or holds null or non-finite
entries has no output rows. Vectors of different lengths cannot share a
covariance: the length with the most distinct vectors (of several the largest)
is fitted, rows of another length have no output rows. Repeated rows count once
in the fit and each get their output. A component needs an eigenvalue above the
rounding of the matrix, so one distinct vector, or none, gives an empty result.
``deviation`` is null where it does not fit a long. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import by_value, release, stage

by_value(__name__)

SCALE = 256
LIMB = 20                       # bits of a limb: a product of two and 2**11 rows stay below 2**53
ROWS = 1 << 11
MAX_STEPS = 12
EPS = float(np.finfo(np.float64).eps)
_WIDTHS = ((1, 1 << 7), (2, 1 << 15), (4, 1 << 31), (8, 1 << 63))


# --- integer vectors ------------------------------------------------------------------

def integers(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the usable vectors of a list<double> column, by length."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)   # nulls are NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    length = np.diff(at)
    good = (bad[at[1:]] == bad[at[:-1]]) & (length > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(length[good]).tolist():
        rows = np.nonzero(good & (length == d))[0]
        with np.errstate(over="ignore"):
            f = np.floor(SCALE * values[at[rows][:, None] + np.arange(d)])
        high, low = f >= 2.0 ** 63, f < -2.0 ** 63
        x = np.where(high | low, 0, f).astype(np.int64)
        x[high], x[low] = (1 << 63) - 1, -1 << 63
        yield rows, x


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it: equal rows, equal bytes."""
    most = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
    out: list[bytes] = [b""] * len(x)
    done = np.zeros(len(x), bool)
    for width, limit in _WIDTHS:
        rows = np.nonzero(~done & (most <= limit - 1))[0]
        blob, step = x[rows].astype(f"<i{width}").tobytes(), width * x.shape[1]
        for k, i in enumerate(rows.tolist()):
            out[i] = blob[k * step:(k + 1) * step]
        done[rows] = True
    return out


def unpacked(blobs: list[bytes], d: int) -> np.ndarray:
    x = np.empty((len(blobs), d), np.int64)
    sizes = np.array([len(b) for b in blobs])
    for width, _ in _WIDTHS:
        rows = np.nonzero(sizes == width * d)[0]
        x[rows] = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), f"<i{width}").reshape(-1, d)
    return x


def limbs(x: np.ndarray, middle: np.ndarray) -> list[np.ndarray]:
    """Float matrices a_p with sum of a_p * 2**(LIMB p) = x - middle, exactly."""
    low, high = x.min(axis=0), x.max(axis=0)
    reach = max((max(abs(int(h) - int(m)), abs(int(lo) - int(m))) for lo, h, m in zip(low, high, middle)), default=0)
    if reach < 1 << LIMB:
        return [(x - middle).astype(np.float64)]
    out, m = [], middle.copy()
    for p in range(4):
        last = p == 3
        part = x if last else x & ((1 << LIMB) - 1)
        out.append((part - (m if last else m & ((1 << LIMB) - 1))).astype(np.float64))
        x, m = x >> LIMB, m >> LIMB
    return out


def _halves(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return total >> 32, total & 0xFFFFFFFF


def _sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column("x").to_pylist(), d)
                high, low = _halves(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high.sum(axis=0)),
                                                  pa.array(low.sum(axis=0))], names=["i", "high", "low"])
    got = fit.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(
        F.sum("high"), F.sum("low")).collect()                                   # d rows
    out = [0] * d
    for i, high, low in got:
        out[i] = (high << 32) + low
    return out


def _products(fit: DataFrame, middle: np.ndarray) -> np.ndarray:
    """Exact sums of (x_i - m_i)(x_j - m_j), as Python integers."""
    d = len(middle)
    i, j = np.triu_indices(d)

    def rows(level: int, total: np.ndarray) -> pa.RecordBatch:
        high, low = _halves(total[i, j])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), level, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             pa.array(high), pa.array(low)], names=["level", "i", "j", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            blobs = b.column("x").to_pylist()
            for at in range(0, len(blobs), ROWS):
                parts = limbs(unpacked(blobs[at:at + ROWS], d), middle)
                for p, left in enumerate(parts):
                    for q, right in enumerate(parts):
                        total[p + q] = total.get(p + q, 0) + (left.T @ right).astype(np.int64)
                held += 1
                if held == 1 << 7:      # up to 4 products of 2**53 at a level and round
                    yield from (rows(k, v) for k, v in total.items())
                    total, held = {}, 0
        yield from (rows(k, v) for k, v in total.items())
    got = fit.select("x").mapInArrow(run, "level int, i int, j int, high long, low long").groupBy("level", "i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")).toPandas()       # at most 7 d (d + 1) / 2 rows
    out = np.zeros((d, d), object)
    for level, a, b, high, low in got.itertuples(index=False):
        out[a, b] += ((int(high) << 32) + int(low)) << (LIMB * int(level))
    return np.where(np.arange(d)[:, None] <= np.arange(d), out, out.T)


# --- eigenvectors -----------------------------------------------------------------------

def _clusters(values: np.ndarray, within: float) -> list[np.ndarray]:
    """Runs of two or more eigenvalues (places, by value) whose neighbours are that close."""
    by = np.argsort(values)
    cut = np.nonzero(np.diff(values[by]) > within)[0] + 1
    return [run for run in np.split(by, cut) if len(run) > 1]


def eigen(a: np.ndarray, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling.
    Differences of eigenvalues below ``floor`` (the rounding of the matrix) are
    not resolved: any orthonormal basis of such a cluster is right."""
    d = len(a)
    size = float(np.abs(a).max()) if d else 0.0
    if size == 0.0:
        return np.zeros(d), np.eye(d)
    a = (a + a.T) / 2
    norm = float(np.linalg.norm(a))
    floor = 4 * EPS * norm if floor is None else floor
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.float64)
    solved: set[tuple[int, ...]] = set()
    for _ in range(MAX_STEPS):
        r = np.eye(d) - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        error = 2 * float(np.linalg.norm(s - np.diag(value)) + norm * np.linalg.norm(r))
        gap = value[None, :] - value[:, None]
        close = np.abs(gap) <= max(error, floor)
        e = np.where(close, r / 2, (s + value[None, :] * r) / np.where(close, 1.0, gap))
        x = x + x @ e
        again = False
        for run in _clusters(value, max(error, floor)):
            own = np.sort(run)
            spread = float(np.ptp(value[run]))
            if tuple(own) in solved:
                continue
            solved.add(tuple(own))
            inner = x[:, own].T @ (a @ x[:, own]) - np.median(value[run]) * (x[:, own].T @ x[:, own])
            if spread > floor or float(np.abs(inner).max()) > floor:
                # a chain of all eigenvalues that the shift does not shrink is left to double precision
                smaller = len(run) < d or float(np.abs(inner).max()) < size / 4
                x[:, own] = x[:, own] @ (eigen(inner, floor)[1] if smaller else np.linalg.eigh((inner + inner.T) / 2)[1])
                again = True
        if not again and float(np.abs(e).max()) < 8 * EPS:
            break
    for _ in range(2):      # rounding over a small gap tilts x a little: orthonormal again to the last bits
        x = x + x @ (np.eye(d) - x.T @ x) / 2
    value = np.einsum("ij,ij->j", x, a @ x)
    by = np.argsort(-value, kind="stable")
    return value[by], x[:, by]


# --- the fit and its use ------------------------------------------------------------------

@dataclass(frozen=True)
class Whitening:
    """A fitted map: ``components`` has a column per component, falling by
    ``eigenvalues``; ``middle`` is the rounded mean, ``rest`` the sums less n times it."""
    n: int
    sums: tuple[int, ...]
    middle: np.ndarray
    rest: tuple[int, ...]
    eigenvalues: np.ndarray
    trace: float
    components: np.ndarray
    identity_error: float

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """The first k whitened coordinates of integer vectors."""
        y = sum(a * 2.0 ** (LIMB * p) for p, a in enumerate(limbs(x, self.middle)))
        y = y - np.array([t / self.n for t in self.rest])
        return (y @ self.components[:, :k]) / np.sqrt(self.eigenvalues[:k])

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)**2, exact; null beyond a long."""
        reach = max((self.n * max(abs(int(h) - int(m)), abs(int(lo) - int(m))) + abs(t) for lo, h, m, t in
                     zip(x.min(axis=0), x.max(axis=0), self.middle, self.rest)), default=0) if len(x) else 0
        if len(self.rest) * reach ** 2 < 1 << 63:
            y = (x - self.middle) * self.n - np.array(self.rest, np.int64)
            return pa.array((y * y).sum(axis=1))
        y = x.astype(object) * self.n - np.array(self.sums, object)
        return pa.array([v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()], pa.int64())


def _fit_list(df: DataFrame, vec_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in integers(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)),
                                                  pa.array(packed(x), pa.binary())], names=["d", "x"])
    vectors = df.select(F.col(vec_col).cast("array<double>").alias("v"))
    return stage(vectors.mapInArrow(run, "d int, x binary").distinct(), "whitening-fit")


def _identity_error(fit: DataFrame, found: Whitening, k: int) -> float:
    """Largest entry of the whitened fit list's covariance, less the identity."""
    d = len(found.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if b.num_rows:
                w = found.project(unpacked(b.column("x").to_pylist(), d), k)
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], names=["i", "j", "v"])
    got = fit.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect()
    total = np.zeros((k + 1, k + 1))                                             # (k + 1)**2 rows
    for i, j, v in got:
        total[i, j] = v
    mean = total[k, :k] / found.n
    return float(np.abs(total[:k, :k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(df: DataFrame, vec_col: str = "embedding", k: int | None = None) -> Whitening | None:
    """The whitening of the distinct integer vectors, with its first k components
    (all by default); None where no component has variance."""
    vectors = _fit_list(df, vec_col)
    size = vectors.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return None
    d, n = size
    vectors_d = vectors.filter(F.col("d") == d)
    sums = _sums(vectors_d, d)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle)]
    t = np.array(rest, object)
    exact = n * _products(vectors_d, np.array(middle, np.int64)) - np.outer(t, t)
    covariance = (exact / (n * n)).astype(np.float64)      # Python division of integers rounds once
    trace = sum(exact.diagonal().tolist()) / (n * n)
    values, components = eigen(covariance)
    kept = int((values > d * EPS * trace).sum())
    kept = kept if k is None else min(kept, k)
    if not kept:
        release(vectors)
        return None
    components = components[:, :kept]
    top = components[np.abs(components).argmax(axis=0), np.arange(kept)]
    found = Whitening(n, tuple(sums), np.array(middle, np.int64), tuple(rest), values[:kept], trace,
                      components * np.sign(top), 0.0)
    found = Whitening(**{**found.__dict__, "identity_error": _identity_error(vectors_d, found, kept)})
    release(vectors)
    return found


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and each of the first k components."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    schema = T.StructType([rows.schema["vec_id"], *T._parse_datatype_string(SCHEMA).fields])
    found = fit(df, vec_col, k)
    if found is None:
        return df.sparkSession.createDataFrame([], schema)
    k, d = len(found.eigenvalues), len(found.rest)
    explained = found.eigenvalues / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = found                                             # d (k + 3) numbers, sent with the task
        for b in batches:
            for at, x in integers(b.column("v")):
                if x.shape[1] == d:
                    r = len(x)
                    every = np.repeat(np.arange(r), k)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("vec_id").take(pa.array(at[every])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)),
                         pa.array(np.full(r * k, w.n)), w.deviation(x).take(pa.array(every)),
                         pa.array(w.project(x, k).ravel()), pa.array(np.tile(explained, r)),
                         pa.array(np.full(r * k, w.identity_error))], names=schema.names)
    return rows.mapInArrow(run, schema)
