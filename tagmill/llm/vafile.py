"""Exact top-k search by inner product with a vector-approximation file.

The file is written once: each of its blocks holds ids, 8-bit cells and the cells' edges in every dimension. A query scans
the cells only. The cells of a dimension are equally wide, so the sum of a query's table look-ups is a product with the
cell numbers, and the true score lies within half the widths, weighted by the query, of the one for the cells' centres. A
block returns the vectors whose upper bound reaches its kth lower bound; the kth lower bound over all blocks leaves a few
of them. The k with the best upper bounds are then read exactly, which gives a certain kth score, and after them those
whose bound reaches it. Exact vectors are only ever joined for such pairs.

Cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; an id on several
rows scores as its best row and is never an answer to itself; ties go to the smaller id; only vectors of equal length
compare; with fewer than k candidates all are returned; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import grid
from .common import cut, table

CELLS, CHUNK = 256, 64
EXACT, LONG = float(1 << 53), (1 << 63) - 1
#: Up to so many ids (8 bytes each) are broadcast to pick the vectors to be read; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _score(x: np.ndarray, q: np.ndarray) -> int:
    """The inner product of whole-numbered vectors, exact, held to the range of a long."""
    if len(x) and np.abs(x).max() * np.abs(q).max() * len(q) >= EXACT:
        return max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(x, q, strict=True))))
    return int(x @ q)


def approximate(ids: np.ndarray, x: np.ndarray) -> list[bytes]:
    """A block of the file: ids, lower edges and widths of the cells, cells."""
    low = x.min(axis=0)
    width = np.maximum((x.max(axis=0) - low) / CELLS, 1e-300)
    cells = np.clip((x - low) / width, 0, CELLS - 1).astype(np.uint8)
    return [ids.tobytes(), low.tobytes(), width.tobytes(), cells.tobytes()]


def bounds(low: np.ndarray, width: np.ndarray, cells: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row of q) the scores of all cells' centres, and how far the true scores may be from them."""
    scale = q * width
    reach = np.abs(q) @ (np.abs(low) + CELLS * width)
    kind = np.float32 if (reach < 1e30).all() and (np.abs(scale) < 1e30).all() else np.float64
    near = (scale.astype(kind) @ cells.T.astype(kind)).astype(np.float64) + (q @ low + 0.5 * scale.sum(axis=1))[:, None]
    rounding = (len(low) + 4) * (2.0**-22 * CELLS * np.abs(scale).sum(axis=1) if kind is np.float32 else 0.0) + 1e-9 * reach
    return near, 0.5 * np.abs(scale).sum(axis=1) + rounding


def _search(k: int):
    def load(parts: list[bytes]):
        ids, low, width = np.frombuffer(parts[0], np.int64), np.frombuffer(parts[1]), np.frombuffer(parts[2])
        cells = np.frombuffer(parts[3], np.uint8).reshape(len(ids), len(low))
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])

        def one(query_ids: np.ndarray, q: np.ndarray) -> list[tuple]:
            out: list[tuple] = []
            for at in range(0, len(q), CHUNK):
                own = query_ids[at : at + CHUNK]
                near, slack = bounds(low, width, cells, q[at : at + CHUNK])
                near[own[:, None] == ids[None, :]] = -np.inf
                best = np.maximum.reduceat(near, starts, axis=1)  # one for each id
                m = min(k, best.shape[1])
                kth = np.partition(best, best.shape[1] - m, axis=1)[:, best.shape[1] - m]
                floor = np.where(np.isfinite(kth), kth - 2 * slack, -np.finfo(float).max)
                for i, j in zip(*np.nonzero(best >= floor[:, None]), strict=True):
                    out.append((int(own[i]), int(ids[starts[j]]), float(best[i, j] - slack[i]), float(best[i, j] + slack[i])))
            return out

        return len(low), one

    return load


def _read(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs`` (query_id, vec_id) with their exact scores."""
    pairs = cut(pairs.select("query_id", "vec_id"))
    ids = pairs.select(F.col("vec_id").alias("id")).distinct()
    if pairs.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = vectors.join(ids, "id", "left_semi").toDF("vec_id", "x")
    both = pairs.join(some, "vec_id").join(queries.toDF("query_id", "q"), "query_id").where(F.size("x") == F.size("q"))

    def scores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [_score(np.asarray(x, float), np.asarray(q, float)) for x, q in zip(pdf["x"], pdf["q"], strict=True)]
            yield pd.DataFrame({"query_id": pdf["query_id"], "vec_id": pdf["vec_id"], "score": np.array(found, np.int64)})

    exact = both.mapInPandas(scores, "query_id long, vec_id long, score long")
    return exact.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def candidates(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, lower, upper: the pairs that the approximation file can't rule out."""
    index = grid.build(vectors, approximate)
    found = cut(grid.scan(index, queries, _search(k), "query_id long, vec_id long, lower double, upper double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    order = W.partitionBy("query_id").orderBy(F.col("lower").desc(), "vec_id")
    kth = best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).groupBy("query_id").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("n"))
    return cut(best.join(kth, "query_id").where((F.col("upper") >= F.col("floor")) | (F.col("n") < k)).select("query_id", "vec_id", "lower", "upper"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products over ``vectors`` but its own id.

    Both have id (long) and v (array<double>, whole numbers).
    """
    order = W.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id")
    left = candidates(vectors, queries, k).withColumn("turn", F.row_number().over(order))
    left = cut(left)
    first = cut(_read(left.where(F.col("turn") <= k), vectors, queries))
    sure = first.groupBy("query_id").agg(F.min("score").alias("sure"))
    more = left.where(F.col("turn") > k).join(sure, "query_id").where(F.col("upper") >= F.col("sure"))
    return grid.ranked(first.unionByName(_read(more, vectors, queries)), F.col("score").desc(), k)


def op1_vafile_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & grid.usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.rint(F.floor(x.cast("double") * 256).cast("double")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))
    return exact_topk(vectors, vectors.where(F.col("id") % 50 == 0), 5)


QUERIES = {"op1_vafile_topk": op1_vafile_topk}
ORACLE = {
    "op1_vafile_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e, len(embedding) AS d FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.d = c.d WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
