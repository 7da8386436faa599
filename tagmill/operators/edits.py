"""Edits of the label store as a log of changes over an unchanging table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def apply_log(boxes: DataFrame, log: DataFrame, n_classes: int) -> DataFrame:
    """``boxes`` (image_id, gi, cls, corners) after ``log`` (image_id, gi, seq, op, cls, corners; op add, delete, class or move).

    For each box the last change of each kind counts, as far as it comes after the last add or delete. Class ids are held
    to the last class. The log is reduced to one row a box before the join.
    """
    life = F.max(F.when(F.col("op").isin("add", "delete"), F.struct("seq", "op", "cls", *CORNERS))).alias("life")
    last = log.groupBy("image_id", "gi").agg(life, F.max(F.when(F.col("op") == "class", F.struct("seq", "cls"))).alias("named"), F.max(F.when(F.col("op") == "move", F.struct("seq", *CORNERS))).alias("moved"))
    rows = boxes.withColumn("_old", F.lit(True)).join(last, ["image_id", "gi"], "full")
    born = F.coalesce(F.col("life.seq"), F.lit(-1))
    alive = F.when(F.col("life").isNotNull(), F.col("life.op") == "add").otherwise(F.coalesce("_old", F.lit(False)))

    def value(name: str, change: str):
        base = F.when(F.col("life").isNotNull(), F.col(f"life.{name}")).otherwise(F.col(name))
        return F.when(F.col(f"{change}.seq") > born, F.col(f"{change}.{name}")).otherwise(base)

    cls = F.least(F.lit(n_classes - 1), F.greatest(F.lit(0), value("cls", "named"))).cast("int")
    return rows.where(alive).select("image_id", "gi", cls.alias("cls"), *[value(c, "moved").alias(f"_{c}") for c in CORNERS]).withColumnsRenamed({f"_{c}": c for c in CORNERS})


def saved_copy(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes after one load and save by an editor that keeps whole pixels: each cycle may move a box a little."""
    from ..functions.geometry import to_centre, to_pixels

    centre = boxes.withColumns(to_centre(*[F.col(c) for c in CORNERS], F.lit(width), F.lit(height)))
    return centre.withColumns(to_pixels(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(width), F.lit(height))).select(*boxes.columns)
