"""Row numbers over a whole table, and what needs them: systematic samples and order statistics.

A window without PARTITION BY sends all rows to one task. Here rows are range-partitioned and sorted by Spark's
distributed sort, every partition numbers its own rows, and the partitions' sizes (one row each) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

_SHIFT = 33  # of monotonically_increasing_id: the partition's number stands above the row's


def numbered(rows: DataFrame, *order: Column | str, name: str = "index", drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with their number (from 0) by ``order``, which should be total, without the columns ``drop``.

    Those columns may decide the order (long texts, say) but are not written with the numbers.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_m", F.monotonically_increasing_id())
    placed = cut(placed.drop(*drop)).withColumn("_p", F.shiftright("_m", _SHIFT))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_p", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_m", "_p", "_start", "_n")


def ranked_within(rows: DataFrame, key: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with their number (from 0) within their key, by one distributed sort: a key may have most of the rows."""
    placed = numbered(rows, key, *order, name="_index")
    firsts = placed.groupBy(F.col(key).alias("_key")).agg(F.min("_index").alias("_first"))
    return placed.join(firsts, placed[key].eqNullSafe(F.col("_key"))).withColumn(name, F.col("_index") - F.col("_first")).drop("_index", "_first", "_key")


def systematic_sample(rows: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """At most ``most`` rows at equal distances: number floor(i * n / most) for i below ``most``; all rows if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    # Row j is number floor(i * n / most) of some i if and only if ceil(j * most / n) falls below (j + 1) * most / n.
    j, step = F.col("_index"), F.lit(most)
    first = F.floor((j * step + (n - 1)) / F.lit(n).cast("double"))
    picked = numbered(rows, *order, name="_index").withColumn("_i", first)
    return picked.where((F.col("_i") < most) & (F.floor(F.col("_i") * F.lit(n) / F.lit(most).cast("double")) == j)).drop("_index", "_i")


def head_sample(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows by ``order``: a top-k with partial results."""
    return rows.orderBy(*order).limit(n)


def order_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median, p95 of each key's values; p95 is the value at place floor(0.95 * (n - 1)) of the sorted ones.

    Ranks come from one distributed sort by (key, value), so a key with most of the rows is no burden on one task.
    """
    placed = ranked_within(rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value), key, value)
    ranked = placed.join(placed.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)
    at95 = F.floor(F.lit(0.95) * (F.col("n") - 1))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    here = ranked.where((F.col("rank") == at95) | (F.col("rank") == low) | (F.col("rank") == high))

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("rank") == place, F.col(value)))

    return here.groupBy(key, "n").agg(((at(low) + at(high)) / 2).alias("median"), at(at95).alias("p95"))
