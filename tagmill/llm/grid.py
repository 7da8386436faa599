"""Searches of many queries over all vectors by an index of blocks that is built once.

Vectors are dealt into blocks by hash; each block becomes one row of a written table, with whatever arrays its searcher
needs. Queries are streamed past the blocks: a task holds one block and a batch of queries at a time, so block and batch
sizes bound its memory whatever the tables' sizes. A block is read by one task, or by a few if blocks are fewer than the
cluster's cores; vectors are never sent to the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Vectors in a block, on average; queries of a block that make a task of their own worth while.
VECTOR_BLOCK, QUERY_SPLIT = 1 << 14, 32


def usable(vec: Column) -> Column:
    """True for arrays without null, NaN or infinite components."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.stack(vectors.to_list()).astype(np.float64)


def build(vectors: DataFrame, make: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """The index of ``vectors`` (id, v): block, parts = ``make(ids, matrix)`` for the vectors of each length in a block.

    Ids ascend within a block; rows that repeat both id and vector count once.
    """
    distinct = vectors.dropDuplicates(["id", "v"])
    n = max(1, -(-vectors.count() // VECTOR_BLOCK))

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        return pd.DataFrame({"block": [key[0]], "parts": [make(pdf["id"].to_numpy(np.int64), matrix(pdf["v"]))]})

    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).withColumn("length", F.size("v"))
    return cut(dealt.groupBy("block", "length").applyInPandas(block, "block int, parts array<binary>"))


def scan(index: DataFrame, queries: DataFrame, load: Callable[[list[bytes]], tuple[int, Callable[[np.ndarray, np.ndarray], list[tuple]]]], schema: str) -> DataFrame:
    """What the index finds for ``queries`` (id, v): rows of ``schema``.

    ``load(parts)`` gives a block's vector length and its search, a function of the ids and the matrix of some queries.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    blocks = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    at_once = 4 * index.sparkSession.sparkContext.defaultParallelism
    splits = max(1, min(-(-at_once // blocks), queries.count() // QUERY_SPLIT))

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, cell = {}, None
        for pdf in parts:
            for key, rows in pdf.groupby(["block", "split"], sort=False):
                if key != cell:
                    held, cell = {}, key
                mine = rows["parts"].notna()
                for row in rows.loc[mine, "parts"]:
                    length, one = load(list(row))
                    held[length] = one
                asked = rows[~mine]
                for length, some in asked.groupby(asked["v"].map(len)):
                    if length in held:
                        yield pd.DataFrame(held[length](some["id"].to_numpy(np.int64), matrix(some["v"])), columns=columns)

    no_parts, no_vector = F.lit(None).cast("array<binary>").alias("parts"), F.lit(None).cast("array<double>").alias("v")
    left = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(None).cast("long").alias("id"), no_vector, "parts")
    own = queries.select(F.pmod(F.xxhash64("id", "v"), F.lit(splits)).cast("int").alias("split"), "id", "v")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "split", "id", "v", no_parts)
    placed = left.unionByName(right).repartition(blocks * splits, "block", "split")
    # A cell's index comes before its queries.
    return placed.sortWithinPartitions("block", "split", F.col("parts").isNull(), "id").mapInPandas(search, schema)


def ranked(found: DataFrame, score: Column, k: int) -> DataFrame:
    """The first k rows of each query by ``score``, then vec_id."""
    order = W.partitionBy("query_id").orderBy(score, "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
