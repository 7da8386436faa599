"""Which box a point lies in and which corner it is near, by a join over a grid of tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: Manhattan distance within which a corner is met.
HANDLE = 11.0


def _tile(value: Column, tile: float) -> Column:
    return F.floor(value / tile)


def _tiles(low: Column, high: Column, tile: float) -> Column:
    return F.explode(F.sequence(_tile(F.least(low, high), tile), _tile(F.greatest(low, high), tile)))


def box_hits(points: DataFrame, boxes: DataFrame, key: str = "image_id", number: str = "gi", tile: float = 64.0) -> DataFrame:
    """``points`` (point, key, x, y) as point and ``hit``: the lowest ``number`` of a box with the point in it or on its edge, else null.

    Boxes (key, number, x1, y1, x2, y2) lie under one another by their numbers, the lowest on top; corners may be in any
    order. A point meets the boxes of its tile only; null coordinates hit nothing; points are unique.
    """
    low = {a: F.least(f"{a}1", f"{a}2") for a in "xy"}
    high = {a: F.greatest(f"{a}1", f"{a}2") for a in "xy"}
    dealt = boxes.select(F.col(key).alias("_k"), F.col(number).alias("_no"), *[low[a].alias(f"_{a}1") for a in "xy"], *[high[a].alias(f"_{a}2") for a in "xy"])
    dealt = dealt.withColumn("_tx", _tiles(F.col("_x1"), F.col("_x2"), tile)).withColumn("_ty", _tiles(F.col("_y1"), F.col("_y2"), tile))
    placed = points.select("point", F.col(key).alias("_k"), "x", "y", _tile(F.col("x"), tile).alias("_tx"), _tile(F.col("y"), tile).alias("_ty"))
    inside = F.col("x").between(F.col("_x1"), F.col("_x2")) & F.col("y").between(F.col("_y1"), F.col("_y2"))
    found = placed.join(dealt, ["_k", "_tx", "_ty"]).where(inside).groupBy("point").agg(F.min("_no").alias("hit"))
    return points.select("point").join(found, "point", "left")


def handle_hits(points: DataFrame, boxes: DataFrame, key: str = "image_id", number: str = "gi", reach: float = HANDLE, tile: float = 64.0) -> DataFrame:
    """``points`` as point, ``hit`` (a box's number), ``handle`` (0 upper left, 1 upper right, 2 lower left, 3 lower right) and ``away``.

    Of the corners at a Manhattan distance of ``reach`` or less the nearest counts, of equals the one of the lowest number,
    then of the first handle; null if there is none. A point stands in each tile that its reach touches, nine at most (there
    are four corners a box, so points are the fewer to deal).
    """
    corners = F.array(*[F.struct(F.lit(k).alias("handle"), F.col(x).alias("cx"), F.col(y).alias("cy")) for k, (x, y) in enumerate((("x1", "y1"), ("x2", "y1"), ("x1", "y2"), ("x2", "y2")))])
    dealt = boxes.select(F.col(key).alias("_k"), F.col(number).alias("hit"), F.explode(corners).alias("c")).select("_k", "hit", "c.*")
    dealt = dealt.withColumn("_tx", _tile(F.col("cx"), tile)).withColumn("_ty", _tile(F.col("cy"), tile))
    placed = points.select("point", F.col(key).alias("_k"), "x", "y")
    placed = placed.withColumn("_tx", _tiles(F.col("x") - reach, F.col("x") + reach, tile)).withColumn("_ty", _tiles(F.col("y") - reach, F.col("y") + reach, tile))
    away = F.abs(F.col("x") - F.col("cx")) + F.abs(F.col("y") - F.col("cy"))
    near = placed.join(dealt, ["_k", "_tx", "_ty"]).withColumn("away", away).where(F.col("away") <= reach)
    best = near.groupBy("point").agg(F.min(F.struct("away", "hit", "handle")).alias("b")).select("point", "b.hit", "b.handle", "b.away")
    return points.select("point").join(best, "point", "left")
