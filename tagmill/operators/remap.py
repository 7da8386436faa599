"""Class vocabularies: mapping, merging and importing boxes.

Class tables have a row a class. They are joined without hints: Spark broadcasts them by their size, and else shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import clip_to_centre
from .numbering import ranked_within


def ordered_union(classes: DataFrame) -> DataFrame:
    """name, cls: all names in the order in which they are first met. ``classes``: source_no, cls, name."""
    first = classes.groupBy("name").agg(F.min(F.struct("source_no", "cls")).alias("place"))
    return first.select("name", (F.row_number().over(W.orderBy("place", "name")) - 1).cast("int").alias("cls"))


def auto_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """``source`` (source, cls, name) to source, src_cls, dst_cls: the first target class of the same name, or null."""
    first = target.groupBy("name").agg(F.min("cls").alias("dst_cls"))
    return source.join(first, "name", "left").select("source", F.col("cls").alias("src_cls"), "dst_cls")


def first_seen_ids(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """name, id: ids from 0 in the order of each name's first row. A row a name reaches the window."""
    first = rows.where(F.trim(name) != "").groupBy(F.trim(name).alias("name")).agg(F.min(F.struct(*order)).alias("place"))
    return first.select("name", (F.row_number().over(W.orderBy("place")) - 1).cast("int").alias("id"))


def apply_map(boxes: DataFrame, class_map: DataFrame, cls: str = "src_cls") -> DataFrame:
    """Boxes with dst_cls; those of unmapped or dropped classes go."""
    known = class_map.where("dst_cls IS NOT NULL").select("source", F.col("src_cls").alias(cls), "dst_cls")
    return boxes.join(known, ["source", cls])


def source_counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("source", "src_cls").agg(F.count(F.lit(1)).alias("n"))


def merge_lines(lines: DataFrame, class_map: DataFrame) -> DataFrame:
    """Lines of a merge reading (source, image_id, line_no, src_cls, rest) with fate (box, dropped or error) and the new line."""
    rows = lines.join(class_map.select("source", "src_cls", "dst_cls"), ["source", "src_cls"], "left")
    fate = F.when(F.col("src_cls").isNull(), "error").when(F.col("dst_cls").isNull(), "dropped").otherwise("box")
    return rows.withColumn("fate", fate).withColumn("line", F.when(fate == "box", F.concat_ws(" ", F.col("dst_cls").cast("string"), F.when(F.col("rest") != "", F.col("rest")))))


def merge_counts(images: DataFrame, lines: DataFrame, drop_empty: bool = True) -> DataFrame:
    """source (null: all), images, boxes, dropped, errors, unlabelled, skipped_empty.

    ``images``: source, image_id; ``lines``: what ``merge_lines`` gives. An image without a label counts as unlabelled, and
    as skipped too if images without boxes are left out. One rollup gives the sources and the total.
    """
    per = lines.groupBy("source", "image_id").agg(*[F.count_if(F.col("fate") == k).alias(k) for k in ("box", "dropped", "error")])
    rows = images.join(per, ["source", "image_id"], "left")
    zero = F.lit(0).cast("long")
    empty = F.coalesce("box", zero) == 0
    skipped = empty if drop_empty else F.lit(False)
    return rows.rollup("source").agg(
        F.count_if(~skipped).alias("images"), F.coalesce(F.sum("box"), zero).alias("boxes"), F.coalesce(F.sum("dropped"), zero).alias("dropped"), F.coalesce(F.sum("error"), zero).alias("errors"),
        F.count_if(F.col("box").isNull()).alias("unlabelled"), F.count_if(skipped).alias("skipped_empty"),
    )


def merged_names(images: DataFrame, prefix: Column, name: Column, *order: Column) -> DataFrame:
    """``images`` with out_name: prefix and name, numbered where the same one comes again.

    Names count without their extension, so that two images never share a label file.
    """
    full = F.when(prefix != "", F.concat(prefix, F.lit("_"), name)).otherwise(name)
    stem, ext = F.regexp_replace(full, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(full, r"(?<=.)(\.[^.]*)$", 1)
    rows = ranked_within(images.withColumn("_stem", stem).withColumn("_ext", ext), "_stem", *order, name="_k")
    k = F.col("_k")
    return rows.withColumn("out_name", F.when(k == 0, F.concat("_stem", "_ext")).otherwise(F.concat("_stem", F.lit("__"), k.cast("string"), "_ext"))).drop("_stem", "_ext", "_k")


def import_boxes(raw: DataFrame, class_map: DataFrame, width: Column, height: Column, skip_flagged: bool = True) -> DataFrame:
    """``raw`` boxes (source, src_cls, x, y, w, h, flagged) with reason (flagged, unmapped, invalid or box), clipped, dst_cls, cx, cy, nw, nh.

    Checks come in this order, and a box has the first reason that holds; a box may be clipped and still be invalid.
    """
    rows = raw.join(class_map.select("source", "src_cls", "dst_cls"), ["source", "src_cls"], "left")
    new = clip_to_centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    bad_size = ~((new["w"] > 0) & (new["w"] <= 1) & (new["h"] > 0) & (new["h"] <= 1))
    reason = F.when(F.col("flagged") & F.lit(skip_flagged), "flagged").when(F.col("dst_cls").isNull(), "unmapped").when(new["degenerate"], "invalid")
    alive = reason.isNull()
    rows = rows.withColumn("clipped", alive & new["clipped"]).withColumn("reason", F.coalesce(reason, F.when(bad_size, "invalid"), F.lit("box")))
    fine = F.col("reason") == "box"
    return rows.withColumns({"cx": F.when(fine, new["cx"]), "cy": F.when(fine, new["cy"]), "nw": F.when(fine, new["w"]), "nh": F.when(fine, new["h"])})


def import_counts(images: DataFrame, imported: DataFrame, drop_empty: bool = True) -> DataFrame:
    """One row: images, missing, boxes, clipped, flagged, unmapped, invalid, skipped_empty. ``images``: image_id, exists, has_size."""
    here = images.where("exists AND has_size").select("image_id")
    per = imported.join(here, "image_id", "left_semi").groupBy("image_id").agg(*[F.count_if(F.col("reason") == k).alias(k) for k in ("box", "flagged", "unmapped", "invalid")], F.count_if("clipped").alias("clipped"))
    rows = images.join(per, "image_id", "left")
    good, zero = F.col("exists") & F.col("has_size"), F.lit(0).cast("long")
    empty = (F.coalesce("box", zero) == 0) & F.lit(drop_empty)
    return rows.agg(
        F.count_if(good & ~empty).alias("images"), F.count_if(~good).alias("missing"), F.coalesce(F.sum("box"), zero).alias("boxes"), *[F.coalesce(F.sum(k), zero).alias(k) for k in ("clipped", "flagged", "unmapped", "invalid")],
        F.count_if(good & empty).alias("skipped_empty"),
    )


def removed_class_map(names: DataFrame, gone: int) -> DataFrame:
    """src_cls, dst_cls after removing one class: later ids move up, and boxes of the class go (null)."""
    c = F.col("cls")
    return names.select(c.alias("src_cls"), F.when(c < gone, c).when(c > gone, c - 1).cast("int").alias("dst_cls"))
