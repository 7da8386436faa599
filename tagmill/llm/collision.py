"""Approximate nearest neighbours by collision counting.

The index is built once: in each block of vectors every one of M random projections keeps its values in a sorted array. A
query opens a window around its own projection in each array (query-centred buckets) and widens all windows together,
which rehashes to larger buckets without new tables. At half-width w a vector at distance w / WIDTH or less lies in a
window with probability ``near_rate`` or more, hence in at least ``threshold`` of the M windows with probability
1 - MISS or more. Vectors that reach the threshold are verified with their true distance. The search ends when the
half-width is WIDTH times the kth distance found: radius and kth distance then meet, and each of the true k nearest has been
verified with that probability. No cap on candidates is set; where distances hardly differ more vectors are verified, at
the latest all.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without id, take no part; an id on
several rows is as near as its nearest row and never an answer to itself; ties go to the smaller id; only vectors of
equal length compare; with fewer than k candidates all are returned; empty tables give an empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .common import table

M, WIDTH, MISS, WIDEN, FIRST = 192, 1.0, 0.08, 1.15, 0.02


def near_rate(width: float = WIDTH) -> float:
    """The probability that a standard normal projection of a unit difference is at most ``width``."""
    return math.erf(width / math.sqrt(2))


def threshold(m: int = M, width: float = WIDTH, miss: float = MISS) -> int:
    """The number of collisions that a vector at the radius reaches with probability 1 - miss."""
    p = near_rate(width)
    return max(1, math.floor(m * p - NormalDist().inv_cdf(1 - miss) * math.sqrt(m * p * (1 - p))))


def _lines(d: int) -> np.ndarray:
    return np.random.default_rng(d).standard_normal((d, M))


def sorted_projections(ids: np.ndarray, x: np.ndarray) -> list[bytes]:
    """A block of the index: ids, vectors, and for each projection the sorted values and the rows they belong to."""
    projected = np.ascontiguousarray((x @ _lines(x.shape[1])).T)
    order = np.argsort(projected, axis=1, kind="stable")
    values = np.take_along_axis(projected, order, axis=1)
    return [ids.tobytes(), x.tobytes(), values.tobytes(), order.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes()]


class Block:
    """A block of the index. ``verified`` counts the vectors whose true distance was computed."""

    def __init__(self, parts: list[bytes]):
        self.ids = np.frombuffer(parts[0], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(parts[1]).reshape(n, len(parts[1]) // (8 * n))
        self.values = np.frombuffer(parts[2]).reshape(M, n)
        self.order = np.frombuffer(parts[3], np.uint16 if n <= 1 << 16 else np.uint32).reshape(M, n)
        self.order = list(self.order.astype(np.intp))
        self.lines, self.need = _lines(self.x.shape[1]), threshold()
        self.firsts = np.flatnonzero(np.r_[True, self.ids[1:] != self.ids[:-1]])
        spread = float(np.median(self.values[:, -1] - self.values[:, 0]))
        farthest = float(np.abs(self.values).max())
        self.start = max(spread * FIRST, farthest * 1e-3, 1e-300)
        #: All arrays one after the other as one sorted array, so that one search finds a place in each of them.
        self.shifts = np.arange(M) * max(4 * farthest, 1e-300)
        self.flat = (self.values + self.shifts[:, None]).ravel()
        self.verified = 0

    def positions(self, wanted: np.ndarray, side: str) -> np.ndarray:
        """Where in each sorted array the wanted value stands, before (left) or after (right) its equals."""
        limit = self.shifts[1] / 2
        return np.searchsorted(self.flat, np.clip(wanted, -limit, limit) + self.shifts, side) - np.arange(M) * len(self.ids)

    def nearest(self, query_id: int, vec: np.ndarray, k: int) -> list[tuple]:
        own, n, centre = self.ids == query_id, len(self.ids), vec @ self.lines
        target = min(k, len(self.firsts) - int(own.any()))
        if not target:
            return []
        counts, done, dist = np.zeros(n, np.int64), own.copy(), np.full(n, np.inf)
        left = self.positions(centre, "left")
        right, half, by_id, radius = left.copy(), self.start, np.full(len(self.firsts), np.inf), np.inf
        while True:
            new_left = np.minimum(left, self.positions(centre - half, "left"))
            new_right = np.maximum(right, self.positions(centre + half, "right"))
            ends = zip(self.order, new_left.tolist(), left.tolist(), right.tolist(), new_right.tolist(), strict=True)
            rings = [part for rows, a, b, c, d in ends for part in (rows[a:b], rows[c:d])]
            counts += np.bincount(np.concatenate(rings), minlength=n)
            left, right = new_left, new_right
            new = np.flatnonzero((counts >= self.need) & ~done)
            if len(new):
                done[new] = True
                self.verified += len(new)
                dist[new] = np.sqrt(((self.x[new] - vec) ** 2).sum(axis=1))
                by_id = np.minimum.reduceat(dist, self.firsts)
                radius = WIDTH * np.partition(by_id, target - 1)[target - 1]
            if done.all() or half >= radius:
                break
            half = min(half * WIDEN, radius)
        best = np.lexsort((self.ids[self.firsts], by_id))[:target]
        return [(int(query_id), int(self.ids[self.firsts[i]]), float(by_id[i])) for i in best if np.isfinite(by_id[i])]


def _search(k: int):
    def load(parts: list[bytes]):
        block = Block(parts)
        return block.x.shape[1], lambda ids, q: [row for i, vec in zip(ids, q, strict=True) for row in block.nearest(i, vec, k)]

    return load


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest (Euclidean) vectors found. Both have id and v (array<double>)."""
    found = grid.scan(grid.build(vectors, sorted_projections), queries, _search(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return grid.ranked(best, F.col("score"), k)


def op9_collision_ann(spark, sf_dir: str) -> DataFrame:
    good = F.col("vec_id").isNotNull() & grid.usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
    rows = table(spark, sf_dir, "embeddings").where(good)
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(vectors, vectors.where(F.col("id") % 100 == 0), 10)


QUERIES = {"op9_collision_ann": op9_collision_ann}
ORACLE: dict = {}
