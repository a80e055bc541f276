"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(scale * c) + shift, staged as packed blocks of rows. The covariance V = XcᵀXc / n of the
centred rows is never formed: one pass multiplies it into a narrow block, V·Q = Xcᵀ(Xc·Q) / n, each task summing over its own
rows and a grouped sum adding the tasks' (dims x width) results. A Lanczos run of a few passes bounds the spectrum from below;
then each round applies a Chebyshev polynomial of degree ``degree`` by its three-term recurrence, one pass a degree. The
polynomial stays small on the unwanted interval [lower bound, smallest Ritz value of the block] and grows fast above it. QR
and Rayleigh-Ritz follow, and rounds end when every wanted component is certified: its residual |V·q - e·q| is at most
``tolerance`` times the largest eigenvalue, checked against one more pass over the data.

The driver holds (dims x width) blocks only. Integer sums per dimension are exact; deviations are exact long values.

Edge cases: vectors that are null or hold null or non-finite entries (or entries beyond 2**52 after scaling) are dropped;
shorter vectors count as filled up with zeros; repeated rows count each, and keep a row each; null ids stay. A component
whose eigenvalue is zero to rounding (one row, equal rows, constant dimensions) has whitened null and explained 0, and does
not enter identity_error; a deviation beyond a long is null. Fewer dimensions than components give one component a dimension;
an empty table or vectors without entries give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.session import stage

SEED = 20_240_512
LANCZOS = 8


def integers(embeddings: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id, x (array of long) of every usable row."""
    vector = F.col("embedding").cast("array<double>")
    scaled = F.transform(vector, lambda c: F.floor(c * scale) + shift)
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c * scale) < float(1 << 52), F.lit(False)))
    return embeddings.filter(F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def matrix_of(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, dims)


class Rows:
    """The staged integer rows with their number, sums and dimensions, and sums over passes of them."""

    def __init__(self, rows: DataFrame, shift: int):
        self.dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
        self.n = 0
        if not self.dims:
            return
        self.rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(self.dims) - F.size("x"))).alias("x"))
        dims = self.dims

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = 0, [0] * dims
            for batch in batches:
                x = matrix_of(batch, 0, dims)
                # Halves of 26 bits cannot overflow within a batch; the total is a Python integer.
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                total = [t + (int(h) << 26) + int(v) for t, h, v in zip(total, high, low)]
                count += len(x)
            if count:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(dims + 1), pa.int32()), pa.array([str(v) for v in [count, *total]])], names=["at", "part"])

        sums = self.rows.select("x").mapInArrow(add, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
        by_place = {r["at"]: int(r.s) for r in sums.collect()}  # one number a dimension
        self.n, self.sums = by_place[0], [by_place[i + 1] for i in range(dims)]
        self.mean = np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    def summed(self, function, shape: tuple[int, ...]) -> np.ndarray:
        """Sum over all rows of function(centred rows), an array of the given shape."""
        dims, mean, size = self.dims, self.mean, int(np.prod(shape))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                total += function(matrix_of(batch, 0, dims) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.ravel())], names=["at", "part"])

        parts = self.rows.select("x").mapInArrow(part, "at int, part double").groupBy("at").agg(F.sum("part").alias("s"))
        out = np.zeros(size)
        for r in parts.collect():  # dims x width numbers
            out[r["at"]] = r.s
        return out.reshape(shape)

    def times(self, block: np.ndarray) -> np.ndarray:
        """V·block in one pass."""
        return self.summed(lambda x: x.T @ (x @ block), block.shape) / self.n


def lower_bound(rows: Rows, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """A safe lower bound of V's spectrum: the smallest Ritz value of a short Lanczos run less its last residual."""
    q = rng.standard_normal(rows.dims)
    basis, alphas, betas = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, rows.dims)):
        v = rows.times(basis[-1][:, None])[:, 0]
        alphas.append(v @ basis[-1])
        for _ in range(2):
            for b in basis:
                v = v - (v @ b) * b
        betas.append(np.linalg.norm(v))
        if betas[-1] <= 1e-13 * max(abs(a) for a in alphas):
            break
        basis.append(v / betas[-1])
    ritz = np.linalg.eigvalsh(np.diag(alphas) + np.diag(betas[:len(alphas) - 1], 1) + np.diag(betas[:len(alphas) - 1], -1))
    return max(0.0, float(ritz[0]) - betas[-1])


def filtered(rows: Rows, block: np.ndarray, applied: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """T_degree of V, with [low, cut] mapped on [-1, 1], times the block, scaled so that ``top`` keeps its size.

    ``applied`` is V·block, known from the last Rayleigh-Ritz, so a filter of degree m costs m - 1 passes.
    """
    centre, half = (cut + low) / 2, (cut - low) / 2
    sigma = first = half / (top - centre)
    before, now = block, (applied - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (rows.times(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def ritz(rows: Rows, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """QR and Rayleigh-Ritz: (values falling, vectors, V·vectors)."""
    q = np.linalg.qr(np.linalg.qr(block)[0])[0]
    applied = rows.times(q)
    small = q.T @ applied
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, applied @ turn


def components(rows: Rows, count: int, spare: int = 16, degree: int = 8, tolerance: float = 1e-14, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of V and their unit vectors (dims x count), each certified by its residual."""
    rng = np.random.default_rng(SEED)
    width = min(rows.dims, count + spare)
    values, block, applied = ritz(rows, rng.standard_normal((rows.dims, width)))
    if values[0] <= 0:
        return np.zeros(count), block[:, :count]
    low = None
    for _ in range(rounds):
        residual = np.linalg.norm(applied[:, :count] - block[:, :count] * values[:count], axis=0).max()
        if residual <= tolerance * values[0]:
            return values[:count], block[:, :count]
        low = lower_bound(rows, rng) if low is None else low
        cut = values[-1]
        if cut - low <= 1e-12 * values[0]:  # nothing left to tell apart below the block
            low = 0.0
            cut = max(cut, 1e-12 * values[0])
        values, block, applied = ritz(rows, filtered(rows, block, applied, degree, low, cut, values[0]))
    raise RuntimeError(f"components not certified: residual {residual / values[0]:.1e} of the largest eigenvalue")


def whiten(embeddings: DataFrame, count: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    rows = Rows(stage(integers(embeddings.select("vec_id", "embedding"), scale, shift), "integer-vectors"), shift)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not rows.n:
        return spark.createDataFrame([], schema)
    dims, n, mean, count = rows.dims, rows.n, rows.mean, min(count, rows.dims)
    values, axes = components(rows, count)
    trace = float(rows.summed(lambda x: np.array([np.einsum("ij,ij->", x, x)]), (1,))[0]) / n
    real = values > 1e-12 * max(trace, 1e-300)
    # Whitened rows have mean 0 up to rounding; first moments are summed beside the second ones all the same.
    turn = np.where(real, axes / np.sqrt(np.where(real, values, 1.0)), 0.0)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ turn
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    seen = rows.summed(moments, (count + 1, count)) / n
    covariance = seen[:count] - np.outer(seen[count], seen[count])
    error = float(np.abs(covariance - np.eye(count))[np.ix_(real, real)].max()) if real.any() else 0.0
    explained = [float(v) / trace if r else 0.0 for v, r in zip(values, real)]
    sums, held = rows.sums, not real.all()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch, 1, dims)
            size = len(x)
            white = (x - mean) @ turn
            if held:
                white[:, ~real] = np.nan
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(size), count))),
                 pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                 pa.array(np.full(size * count, n)),
                 deviations(x, n, sums).take(pa.array(np.repeat(np.arange(size), count))),
                 pa.array(white.ravel(), from_pandas=True), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.rows.mapInArrow(project, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n*x - S)**2 per row, exact; null where it does not fit a long."""
    largest = max(max(abs(n * int(v) - s) for v in (hi, lo)) for hi, lo, s in zip(x.max(axis=0), x.min(axis=0), sums)) if len(x) else 0
    safe = largest * largest * x.shape[1] < 1 << 63 and max(map(abs, sums), default=0) < 1 << 63 and n * int(np.abs(x).max(initial=0)) < 1 << 63
    if safe:
        apart = n * x - np.array(sums, dtype=np.int64)
        return pa.array((apart * apart).sum(axis=1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
