"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every vector is projected on ``projections`` random directions (whole random rotations, so that directions of one rotation
are orthogonal); a block of vectors holds, per direction, its projections in sorted order. A query opens a window around
its own projection in each array. Windows grow by virtual rehashing: the half-width is ``reach`` standard deviations of
the projected difference of two points that lie a radius r apart, and r rises by ``growth`` without rebuilding anything. A
vector that lies inside at least ``threshold`` of the windows is verified on the original vectors. A query closes in a
block when its k-th verified neighbour lies within r, so no count of candidates ends the search.

Largest inner product becomes smallest distance by one more coordinate: vectors get sqrt(M^2 - |x|^2), M being the largest
norm, and queries are scaled to norm M, which changes no order.

Rows with one and the same vector are one class, searched once: a class carries its ``k + 1`` smallest ids, which is all that
any result can show, and queries of one class share their answer. Classes are dealt to blocks of about ``block`` by hash;
queries visit every block; each pair gives at most k + 1 rows, which a ranked window merges. Work is queries times vectors,
as a stated query set against all rows asks; a block, its arrays and one Arrow batch of queries are all a task holds.

Edge cases: vectors that are null, zero, or hold null or non-finite components (or whose squared norm is no finite
positive double), and rows without an id take no part. Shorter vectors count as filled up with zeros. Repeated rows of one
id and vector are one row, and a query never meets a row of its own id. Equal scores go to the smaller id; fewer
candidates than k give all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.session import stage

SEED = 20_240_511
SEEDS_PER_BLOCK = 64


def directions(dims: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` unit rows: the rows of as many random rotations as needed."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(math.ceil(count / dims))]
    return np.concatenate(turns)[:count]


def threshold(count: int, reach: float, slack: float = 1.5) -> int:
    """Collisions that a vector at distance r exactly has but for ``slack`` standard deviations."""
    p = math.erf(reach / math.sqrt(2))
    return max(1, math.floor(count * p - slack * math.sqrt(count * p * (1 - p))))


class Block:
    """The sorted arrays of one block of vectors, and the search of queries in them."""

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, vectors: np.ndarray, axes: np.ndarray, norm: float, reach: float, growth: float):
        self.ids, self.firsts, self.vectors, self.norm, self.growth = ids, firsts, vectors, norm, growth
        self.axes, self.least = axes, threshold(len(axes), reach)
        # A unit direction sees a difference of length r with a deviation of r / sqrt(dims).
        self.width = reach / math.sqrt(axes.shape[1])
        lift = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        places = (axes[:, :-1] @ vectors.T + axes[:, -1:] * lift).astype(np.float32)
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=1)
        self.rank = np.empty(order.shape, dtype=np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)

    def scores(self, rows, query: np.ndarray) -> np.ndarray:
        return (self.vectors[rows] * query).sum(axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per vector, the number of windows [low, high) it lies in. Places below ``low`` wrap around and fail the test."""
        inside = (self.rank - low[:, None]) < (high - low)[:, None]
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16)

    def search(self, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the block, scores), best first, per query."""
        size = len(self.ids)
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        places = ((queries * (self.norm / lengths)[:, None]) @ self.axes[:, :-1].T).astype(np.float32)
        apart = lambda score, i: math.sqrt(max(0.0, 2 * self.norm * (self.norm - score / lengths[i])))
        seeds = np.arange(min(size, SEEDS_PER_BLOCK))
        found, seen = [], []
        for i in range(len(queries)):
            flags = np.zeros(size, dtype=bool)
            flags[seeds] = True
            seen.append(flags)
            found.append(self.best(seeds, self.scores(seeds, queries[i]), k))
        radius = np.array([apart(s[0], i) / self.growth if len(s) else 0.0 for i, (_, s) in enumerate(found)])
        radius = np.maximum(radius, 1e-6 * self.norm)
        open_ = np.arange(len(queries))
        while len(open_):
            half = (self.width * radius[open_]).astype(np.float32)
            low = np.empty((len(open_), len(self.axes)), dtype=np.uint16)
            high = np.empty_like(low)
            for a, line in enumerate(self.sorted):
                low[:, a] = np.searchsorted(line, places[open_, a] - half, side="left")
                high[:, a] = np.searchsorted(line, places[open_, a] + half, side="right")
            still = []
            for j, i in enumerate(open_):
                # No two points are farther apart than 2 M: the last ring takes whatever is left.
                all_in = radius[i] >= 2 * self.norm
                fresh = np.flatnonzero(~seen[i] if all_in else (self.collisions(low[j], high[j]) >= self.least) & ~seen[i])
                if len(fresh):
                    seen[i][fresh] = True
                    rows, scores = found[i]
                    found[i] = self.best(np.concatenate([rows, fresh]), np.concatenate([scores, self.scores(fresh, queries[i])]), k)
                last = apart(found[i][1][-1], i) if len(found[i][1]) >= k else math.inf
                if not all_in and last > radius[i] * (1 + 1e-9):
                    radius[i] = min(radius[i] * self.growth, last)
                    still.append(i)
            open_ = np.array(still, dtype=int)
        return iter(found)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.firsts[rows], -scores))[:k]
        return rows[order], scores[order]


def usable(vector: Column) -> Column:
    """A double vector that is not null, not zero and holds only finite components."""
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """rows(vec_id, vector) -> cid, vector, ids: the ``keep`` smallest ids of each distinct vector, staged."""
    nth = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.distinct().withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= keep)
    grouped = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most ``keep`` ids
    return stage(grouped.select(F.monotonically_increasing_id().alias("cid"), "vector", "ids"), "vector-classes")


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    query_every: int = 20,
    projections: int = 128,
    reach: float = 1.2,
    growth: float = 1.25,
    block: int = 8192,
) -> DataFrame:
    """embeddings(vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found of each row whose id ``query_every`` divides."""
    if not 0 < projections <= 255 or not 0 < block <= 32_768:
        raise ValueError("at most 255 projections and blocks of 32 768 vectors")
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    known = classes(rows, k + 1)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, top, dims = known.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("vector"))).first()
    dims, norm, blocks = dims or 1, math.sqrt(top or 1.0) * (1 + 1e-12), max(1, math.ceil(n / block))
    asked = stage(
        rows.filter(F.col("vec_id") % query_every == 0).distinct().join(known.select("vector", "cid"), "vector").select("vec_id", "cid"), "queries")

    filled = F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("vector"))).alias("vector")
    base = known.select(
        F.pmod(F.xxhash64("cid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "cid", F.col("ids")[0].alias("first"), filled)
    posed = known.join(asked.select("cid").distinct(), "cid", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "cid", F.col("ids")[0].alias("first"), filled)
    dealt = base.unionByName(posed).repartition(blocks, "block").sortWithinPartitions("block", "kind", "cid")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = directions(dims + 1, projections)
        number, parts, here = None, [], None
        for batch in batches:
            blocks_, kinds, ids, firsts = (batch.column(c).to_numpy() for c in range(4))
            values = batch.column(4).flatten().to_numpy().reshape(-1, dims)
            cuts = np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if blocks_[a] != number:
                    number, parts, here = blocks_[a], [], None
                if kinds[a] == 0:
                    parts.append((ids[a:b], firsts[a:b], values[a:b]))
                    continue
                if here is None:
                    if not parts:
                        continue
                    here = Block(*(np.concatenate(x) for x in zip(*parts)), axes, norm, reach, growth)
                    parts = []
                out = list(here.search(values[a:b], k + 1))
                counts = [len(rows) for rows, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[a:b], counts)), pa.array(here.ids[np.concatenate([rows for rows, _ in out])]),
                     pa.array(np.concatenate([scores for _, scores in out]))], names=["query", "cid", "score"])

    found = dealt.mapInArrow(search, "query long, cid long, score double")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    firsts = known.select("cid", F.col("ids")[0].alias("first"), "ids")
    best = (
        found.join(firsts, "cid").withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1)
        .groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("best"))  # at most k + 1 classes
    )
    hits = F.expr("flatten(transform(best, b -> transform(b.ids, i -> struct(-b.score AS away, i AS vec_id))))")
    ranked = (
        asked.withColumnRenamed("vec_id", "query_id").join(best.select(F.col("query").alias("cid"), hits.alias("hits")), "cid")
        .withColumn("hits", F.slice(F.sort_array(F.filter("hits", lambda h: h.vec_id != F.col("query_id"))), 1, k))
    )
    return ranked.select("query_id", F.posexplode("hits").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.away")).alias("score"))
