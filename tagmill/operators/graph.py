"""Connected components of an edge table, and joins on keys that may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is hot if it holds more than 1 / HOT_SHARE of all rows (so there are fewer than HOT_SHARE such keys, which is
#: what a broadcast of them is bounded by) and more than HOT_LEAST rows.
HOT_SHARE, HOT_LEAST, SALTS = 10_000, 1_000, 8


def hot_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The hot keys among the n rows, fewer than HOT_SHARE, found with partial counts."""
    often = F.col("_rows") > max(HOT_LEAST, n // HOT_SHARE)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(often).select(key)


def hot_join(rows: DataFrame, by: DataFrame, key: str, n: int, hot: DataFrame | None = None) -> DataFrame:
    """The inner join of n ``rows`` with ``by`` (one row a key), where a few keys may hold most of ``rows``.

    Hot keys' rows stay where they are and meet their few partners by a broadcast; all others are shuffled.
    """
    hot = hot_keys(rows, key, n) if hot is None else hot
    if n <= HOT_LEAST or not hot.take(1):
        return rows.join(by, key)
    few = by.join(F.broadcast(hot), key, "left_semi")
    others = rows.join(F.broadcast(hot), key, "left_anti").join(by, key)
    return rows.join(F.broadcast(few), key).unionByName(others)


def components(edges: DataFrame, merge: bool = False) -> DataFrame:
    """(u, v) to (node, root): the smallest node reachable, for every node of an edge.

    A round hands the smallest label over every edge; what a node hears also goes to the node that its old label names,
    so that whole trees are hooked and not their leaves alone; then each label is replaced by its own label, which halves
    the paths. Rounds thus grow with the logarithm of the longest chain. What a round gives is checkpointed in the shared
    folder. A label that very many nodes bear is dealt over SALTS keys, and so are the edges of a node by their far end:
    only labels in use, and the labels of nodes that are hubs, are copied for that. With ``merge`` labels are shuffled only:
    else Spark broadcasts them through the driver, a few times a round, as long as they stay below its threshold.
    """
    by = (lambda df: df.hint("merge")) if merge else (lambda df: df)
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("way")
    both = cut(edges.where("u <> v").select(ways).select("way.u", "way.v").distinct())  # both ways from one run of what made the edges
    ends = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("least"))
    nodes = cut(ends.select(F.col("u").alias("node"), F.when(F.col("degree") > HOT_LEAST, SALTS).otherwise(1).alias("salts"), F.least("u", "least").alias("root")))
    hubs = nodes.where("salts > 1").select(F.col("node").alias("v"), "salts")
    if hubs.take(1):
        both = cut(both.join(hubs, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("salts", F.lit(1))).alias("salt")))
    else:
        both = both.withColumn("salt", F.lit(0).cast("long"))
    labels = nodes
    while True:
        said = labels.select(F.col("node").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("root").alias("said"))
        heard = both.join(by(said), ["v", "salt"]).groupBy(F.col("u").alias("node")).agg(F.min("said").alias("said"))
        near = cut(labels.join(by(heard), "node").select("node", "salts", F.col("root").alias("was"), F.least("root", "said").alias("root")))
        hooks = near.where("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("hook"))
        near = near.join(by(hooks), "node", "left").select("node", "salts", "was", F.least("root", "hook").alias("root"))
        used = near.select("root").distinct()
        far = used.join(by(near.select(F.col("node").alias("root"), F.col("root").alias("beyond"))), "root")
        far = far.select("root", "beyond", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1))).alias("salt"))
        spread = near.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        moved = cut(spread.join(by(far), ["root", "salt"]).select("node", "salts", "was", F.least("root", "beyond").alias("root")))
        labels = moved.select("node", "salts", "root")
        if moved.where("was <> root").isEmpty():
            return labels.select("node", "root")
