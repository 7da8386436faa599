"""Non-maximum suppression: of boxes that overlap, the most confident stays.

Walking an image's boxes by falling confidence, a box goes if it overlaps one that stays by more than a threshold. Only
pairs of boxes that overlap that much decide, and they come from the tiled join of ``matching.overlaps``, so an image with
very many boxes is spread over many tasks. A box without a stronger one beside it stays, and those beside it go; the next
such boxes are found among what is left. Images with few pairs take these steps as one fold in the JVM, others as rounds
of joins, as many as a box has undecided stronger ones one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from .matching import CORNERS, overlaps

#: Overlapping pairs of an image that one fold walks through; images with more are decided by rounds of joins.
CROWD = 5_000


def suppressed(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and box of what goes, by ``pairs`` (keys, win, win_conf, lose): two boxes that overlap, the stronger as ``win``.

    ``win`` and ``lose`` are numbers within the keys; stronger is who has more confidence or, of equals, the lower number.
    """
    pairs = cut(pairs.select(*keys, "win", "win_conf", "lose"))
    many = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select(*keys)
    if not many.take(1):
        return _fold(pairs, keys)
    many = cut(many)
    return _fold(pairs.join(many, keys, "left_anti"), keys).unionByName(_rounds(pairs.join(many, keys, "left_semi"), keys))


def _fold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs by falling confidence of the stronger: all pairs that it loses come before those that it wins."""
    order = F.struct((-F.col("win_conf")).alias("c"), F.col("win").alias("w"), F.col("lose").alias("l"))
    rows = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("p"))

    def walk(gone: Column, p: Column) -> Column:
        return F.when(F.array_contains(gone, p["w"]) | F.array_contains(gone, p["l"]), gone).otherwise(F.array_append(gone, p["l"]))

    gone = F.aggregate("p", F.array().cast("array<long>"), walk)
    return rows.select(*keys, F.explode(gone).alias("box"))


def _rounds(pairs: DataFrame, keys: list[str]) -> DataFrame:
    left, gone = cut(pairs.select(*keys, "win", "lose")), None
    while True:
        losers = left.select(*keys, F.col("lose").alias("box")).distinct()
        stays = left.select(*keys, F.col("win").alias("box")).distinct().join(losers, [*keys, "box"], "left_anti")
        beside = left.join(stays.withColumnRenamed("box", "win"), [*keys, "win"]).select(*keys, F.col("lose").alias("box")).distinct()
        beside = cut(beside)
        if beside.isEmpty():
            return losers.limit(0) if gone is None else gone
        gone = beside if gone is None else gone.unionByName(beside)
        # Whoever beats only boxes that go, or is decided itself, beats nobody any more.
        other = left.join(beside.withColumnRenamed("box", "lose"), [*keys, "lose"], "left_anti").join(beside.withColumnRenamed("box", "win"), [*keys, "win"], "left_anti")
        left = cut(other)


def non_maximum(boxes: DataFrame, keys: tuple[str, ...] = ("image_id",), number: str = "pr", threshold: float = 0.45, least_conf: float = 0.25, most: int | None = 300, agnostic: bool = False, cls: str = "cls", conf: str = "conf", tile: float = 256.0) -> DataFrame:
    """The rows of ``boxes`` that stay, with their ``place`` (from 1) in their image by falling confidence.

    ``boxes``: keys, ``number`` (long, unique within the keys; of equals in confidence the lower comes first), cls, conf, x1,
    y1, x2, y2. Boxes below ``least_conf``, and those with a null or NaN confidence, go first. A box goes if its overlap with
    one that stays is above ``threshold``, of its class only or (``agnostic``) of any; a null class is a class. At most
    ``most`` boxes of an image stay, over all classes. Boxes with null corners overlap nothing.
    """
    own = list(keys)
    rows = boxes.where((F.col(conf) >= least_conf) & ~F.isnan(conf))
    slim = rows.select(*own, F.col(number).cast("long").alias("no"), F.col(conf).alias("conf"), F.struct(F.col(cls).alias("v")).alias("of"), *CORNERS)
    pairs = overlaps(slim, slim, threshold, keys, tile).where(F.col("iou") > threshold)
    stronger = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_no") < F.col("b_no")))
    same = F.lit(True) if agnostic else F.col("a_of.v").eqNullSafe(F.col("b_of.v"))
    pairs = pairs.where(stronger & same).select(*own, F.col("a_no").alias("win"), F.col("a_conf").alias("win_conf"), F.col("b_no").alias("lose"))
    gone = suppressed(pairs, own).withColumnRenamed("box", "_gone")
    stays = rows.join(gone, [*[rows[k] == gone[k] for k in own], rows[number] == gone["_gone"]], "left_anti")
    place = F.row_number().over(W.partitionBy(*own).orderBy(F.col(conf).desc(), number))  # with ``most`` each task hands on no more rows an image
    placed = stays.withColumn("place", place)
    return placed if most is None else placed.where(F.col("place") <= most)
