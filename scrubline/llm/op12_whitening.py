"""Whitened embeddings by incremental eigendecomposition.

1. Each partition keeps the spectrum of its rows' scatter matrix: eigenvalues and
   eigenvectors, mean and count.  A row (a vector and how often it stands in the
   batch) moves the mean and adds one centred rank-one term; the new eigenvalues
   are the roots of the secular equation, after deflation of directions that the
   term does not touch and of equal eigenvalues.
2. Partitions' spectra are combined in a tree, 16 at a time: an eigenpair of the
   one is a rank-one update of the other, and so is the distance of the means.
3. The basis so found is orthonormal to rounding but need not be the eigenvectors
   to double precision.  A distributed Rayleigh-Ritz step projects every centred
   row on it, sums the small matrix of products and diagonalises that.
4. Another pass over all rows measures the whitened covariance; the last one
   writes the projections.

What travels is a spectrum or a ``d`` x ``d`` matrix for each partition, never
rows; the driver gets one of each.  Rows are centred as exact whole numbers,
``n * x - S``, before anything is multiplied.

Rows whose vector is null or holds null or non-finite entries are left out, and
so are vectors of another length than most rows have (the greater length on a
tie).  Directions without variance have no component: no rows, equal vectors or a
single one give none, and fewer than eight dimensions as many as they have.  A
deviation beyond 64 bits comes back as null.  Repeated rows and null ids stay as
they are; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace, stage
from .common import map_groups, table

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
FAN_IN = 16
TINY = 1e-12  # of the trace: a direction with less has no variance
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``diag(d) + rho z z'`` for ascending distinct ``d``, no zero
    in ``z``, positive ``rho``; and ``gap[i, k] = d[i] - root[k]`` without
    cancellation.

    Every root is sought from the nearer of its two poles.  A step fits a rational
    function with these poles to value and slope; one that leaves the bracket is
    replaced by halving it.
    """
    m = len(d)
    zz = rho * z * z
    upper = np.r_[d[1:], d[-1] + zz.sum()]
    middle = 0.5 * (d + upper)
    f = 1 + (zz[:, None] / (d[:, None] - middle)).sum(axis=0)
    near_left = (f >= 0) | (np.arange(m) == m - 1)
    origin = np.where(near_left, d, upper)
    delta = d[:, None] - origin  # poles seen from each root's origin
    half = 0.5 * (upper - d)
    low = np.where(near_left, 0.0, -half)
    high = np.where(near_left, np.where(f >= 0, half, upper - d), 0.0)
    low = np.where(near_left & (f < 0), half, low)  # the last root beyond the middle
    left = (np.arange(m)[:, None] <= np.arange(m)).astype(float)
    last = np.arange(m) == m - 1
    ones = np.ones(m)
    pole = d - origin
    next_pole = np.where(last, 0.0, upper - origin)
    tau = 0.5 * (low + high)
    for _ in range(60):
        gap = delta - tau
        term = zz[:, None] / gap
        negative, whole = ones @ (term * left), ones @ term
        f = 1 + whole
        found = np.abs(f) <= 8 * m * _EPS * (1 + whole - 2 * negative)
        if found.all():
            break
        low = np.where(f < 0, tau, low)
        high = np.where(f > 0, tau, high)
        slope = term / gap
        at, to = pole - tau, next_pole - tau
        a = ones @ (slope * left)
        b = np.where(last, 0.0, (ones @ slope - a) * to * to)
        a *= at * at
        with np.errstate(all="ignore"):
            c = f - a / at - np.where(last, 0.0, b / to)
            # c + a / (at - s) + b / (to - s) = 0 for the step s
            p = c * (at + to) + a + b
            q = c * at * to + a * to + b * at
            root = np.sqrt(np.maximum(p * p - 4 * c * q, 0))
            step = np.where(p >= 0, 2 * q / (p + root), (p - root) / (2 * c))
            step = np.where(last, at + a / c, step)
        new = tau + step
        fine = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(found, tau, np.where(fine, new, 0.5 * (low + high)))
        if (new == tau).all():
            break
        tau = new
    return origin + tau, delta - tau


def rank_one(values: np.ndarray, vectors: np.ndarray, rho: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``V diag(values) V' + rho x x'``; values ascend."""
    z = vectors.T @ x
    norm = np.sqrt(z @ z)
    if rho <= 0 or norm == 0:
        return values, vectors
    size = max(values[-1], rho * norm * norm)
    tol = 8 * _EPS * size
    # equal values: turn their directions so that the term touches one of them
    edges = np.flatnonzero(np.r_[True, np.diff(values) > tol, True])
    turned = False
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            part = z[a:b]
            length = np.sqrt(part @ part)
            if length > 0:
                if not turned:
                    vectors, z, turned = vectors.copy(), z.copy(), True
                u = part.copy()
                u[-1] += np.copysign(length, part[-1])
                u *= np.sqrt(2 / (u @ u))
                block = vectors[:, a:b]
                vectors[:, a:b] = block - np.outer(block @ u, u)
                part = np.zeros(b - a)
                part[-1] = -np.copysign(length, z[b - 1])
                z[a:b] = part
    touched = np.flatnonzero(rho * norm * np.abs(z) > tol)
    if not len(touched):
        return values, vectors
    d, w = values[touched], z[touched]
    if len(touched) > 1:
        roots, gap = secular_roots(d, w, rho)
        # the term for which these roots are exact: its vectors are orthogonal
        m = len(d)
        away = d[None, :] - d[:, None]
        away[np.arange(m), np.arange(m)] = 1.0
        below = np.arange(m)[None, :] < np.arange(m)[:, None]  # root k under pole i
        ratio = np.where(below, -gap / np.where(below, away, 1.0), 1.0)
        above = np.zeros((m, m), bool)
        above[:, :-1] = ~below[:, :-1]
        shifted = np.ones((m, m))
        shifted[:, :-1] = np.where(above[:, :-1], d[None, 1:] - d[:, None], 1.0)
        ratio = np.where(above, -gap / np.where(above, shifted, 1.0), ratio)
        ratio[:, -1] = -gap[:, -1]
        w = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1))), w)
        turn = w[:, None] / gap
        turn /= np.sqrt((turn * turn).sum(axis=0))
    else:
        roots, turn = d + rho * w * w, np.ones((1, 1))
    values, vectors = values.copy(), vectors.copy()
    values[touched] = roots
    vectors[:, touched] = vectors[:, touched] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, and the scatter's spectrum of the rows seen so far."""

    def __init__(self, size: int):
        self.n, self.sums = 0, [0] * size
        self.mean = np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray, times: int) -> None:
        weight = self.n * times / (self.n + times)
        away = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, weight, away)
        self.n += times
        self.mean = self.mean + away * (times / self.n)

    def merge(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, mean: np.ndarray) -> None:
        for value, vector in zip(values, vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, value, vector)
        self.add(mean, n)
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def row(self) -> tuple:
        return (self.n, [str(s) for s in self.sums], self.values.tolist(), self.vectors.ravel().tolist(),
                self.mean.tolist())


STATE = "n long, sums array<string>, spectrum array<double>, basis array<double>, mean array<double>"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``vec, x``: ids and whole-number vectors of the rows that take part, and
    their length."""
    entry = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(entry, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))
    known = vectors.where(good & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("vec"),
        F.transform(entry, lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET).alias("x"))
    length = known.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), F.desc("d")).first()
    size = length["d"] if length else 0
    return known.where(F.size("x") == size), size


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spectra(rows: DataFrame, size: int) -> DataFrame:
    """One spectrum for each partition that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Spectrum(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, size)
            # 32-bit halves sum without overflow
            high = (x >> 32).sum(axis=0).tolist()
            low = (x & 0xFFFFFFFF).sum(axis=0).tolist()
            state.sums = [s + (a << 32) + b for s, a, b in zip(state.sums, high, low, strict=True)]
            distinct, times = np.unique(x, axis=0, return_counts=True)
            for row, k in zip(distinct.astype(float), times.tolist(), strict=True):
                state.add(row, k)
        if state.n:
            names = ["n", "sums", "spectrum", "basis", "mean"]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in state.row()], names=names)

    return rows.select("x").mapInArrow(run, STATE)


def combined(parts: DataFrame, size: int) -> Spectrum:
    """All partitions' spectra, combined in a tree of written rounds."""
    level = stage(parts.withColumn("k", F.monotonically_increasing_id()), "spectra")
    while True:
        n = level.count()
        if n <= 1:
            break
        groups = -(-n // FAN_IN)

        def make():
            def join(key, rows):
                state = Spectrum(size)
                for n, sums, values, basis, mean in rows:
                    state.merge(n, [int(s) for s in sums], np.array(values),
                                np.array(basis).reshape(size, size), np.array(mean))
                return [(*state.row(), key)]
            return join

        dealt = level.selectExpr(f"pmod(xxhash64(k), {groups}) as g", "n", "sums", "spectrum", "basis", "mean")
        level = stage(map_groups(dealt, "g", make, STATE + ", k long"), "spectra")
    row = level.first()
    state = Spectrum(size)
    if row:
        state.n, state.sums = row["n"], [int(s) for s in row["sums"]]
        state.values, state.vectors = np.array(row["spectrum"]), np.array(row["basis"]).reshape(size, size)
    return state


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact ``n * x - S``; whole numbers of any size if 64 bits do not hold them."""
    if n * max(1, int(np.abs(x).max())) < 2**61 and max(map(abs, sums)) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def square_sums(away: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null where 64 bits do not hold one."""
    top = max(abs(int(away.max())), abs(int(away.min())))
    if away.dtype == object or top >= 2**47 or away.shape[1] > 2**12:
        out = [sum(int(v) * int(v) for v in row) for row in away]
    else:
        high, low = away >> 24, away & 0xFFFFFF
        parts = zip((high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(),
                    (low * low).sum(axis=1).tolist(), strict=True)
        out = [(a << 48) + (b << 25) + c for a, b, c in parts]
    return [v if v < 2**63 else None for v in out]


def product_sums(rows: DataFrame, size: int, n: int, sums: list[int], basis: np.ndarray) -> tuple:
    """Over all rows, with ``y`` the centred row projected on ``basis``: the sums
    of ``y`` and of ``y y'``."""
    m = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            if batch.num_rows:
                y = (centred(_matrix(batch, size), n, sums) / n).astype(float) @ basis
                first += y.sum(axis=0)
                second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[first, second.ravel()]])], names=["s"])

    parts = rows.select("x").mapInArrow(run, "s array<double>")
    total = np.array([r["s"] for r in parts.select(F.posexplode("s").alias("p", "v")).groupBy("p").agg(
        F.sum("v").alias("s")).orderBy("p").collect()])
    return total[:m], total[m:].reshape(m, m)


class Whitening:
    """What the rows are centred and projected with."""

    def __init__(self, n: int, sums: list[int], directions: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.directions, self.values, self.trace = n, sums, directions, values, trace


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """Leading eigenvectors of the rows' covariance, to double precision."""
    state = combined(spectra(rows, size), size)
    n, sums = state.n, state.sums
    basis, _ = np.linalg.qr(state.vectors[:, ::-1])
    _, products = product_sums(rows, size, n, sums, basis)
    products = (products + products.T) / (2 * n)
    values, ritz = np.linalg.eigh(products)
    values, ritz = values[::-1], ritz[:, ::-1]
    trace = float(np.trace(products))
    kept = int((values[:components] > TINY * trace).sum()) if trace > 0 else 0
    return Whitening(n, sums, basis @ ritz[:, :kept], values[:kept], trace)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of
    every row that takes part and each component."""
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (f"vec {kind}, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    rows, size = usable(vectors, id_col, vector_col)
    model = fit(rows, size, components) if size else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("vec", id_col)
    n, sums, m = model.n, model.sums, len(model.values)
    scaled = model.directions / np.sqrt(model.values)
    first, second = product_sums(rows, size, n, sums, scaled)
    spread = second / n - np.outer(first / n, first / n)
    error = float(np.abs(spread - np.eye(m)).max())
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = centred(_matrix(batch, size), n, sums)
            y = (away / n).astype(float) @ scaled
            k = batch.num_rows
            each = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                pa.array(np.full(k * m, n, np.int64)),
                pa.array(square_sums(away), pa.int64()).take(pa.array(each)),
                pa.array(y.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                names=["vec", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec", "x").mapInArrow(run, schema).withColumnRenamed("vec", id_col)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark):
        return whiten(table(spark, sf_dir, "embeddings"))
