"""The audit of a labelled dataset: findings of every image, and the summaries of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import area_bucket
from ..functions.text import status_mark, text_bar
from ..session import cut


def audit(images: DataFrame, labels: DataFrame, parsed: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """image_id, has_label, n_boxes, n_errors, n_warns, dup_group, dup_rep, mark for every image.

    ``labels``: image_id of every label file; ``parsed``: its strict reading; ``groups``: image_id, dup_group, dup_rep. A
    missing label and a label without boxes or errors are warnings.
    """
    found = parsed.groupBy("image_id").agg(
        F.count_if("kept").alias("n_boxes"), F.sum(F.size("errors")).alias("n_errors"), F.sum(F.size("warns")).alias("n_warns"), F.count_if(F.size("errors") > 0).alias("n_bad")
    )
    rows = images.select("image_id").join(labels.select("image_id", F.lit(True).alias("has_label")).distinct(), "image_id", "left").join(found, "image_id", "left")
    none = F.lit(0).cast("long")
    rows = rows.select("image_id", F.coalesce("has_label", F.lit(False)).alias("has_label"), *[F.coalesce(c, none).alias(c) for c in ("n_boxes", "n_errors", "n_warns")])
    alone = ~F.col("has_label") | ((F.col("n_boxes") == 0) & (F.col("n_errors") == 0))
    rows = rows.withColumn("n_warns", F.col("n_warns") + F.when(alone, 1).otherwise(0))
    if groups is None:
        rows = rows.withColumn("dup_group", F.lit(None).cast("long")).withColumn("dup_rep", F.lit(False))
    else:
        rows = rows.join(groups.select("image_id", "dup_group", "dup_rep"), "image_id", "left").withColumn("dup_rep", F.coalesce("dup_rep", F.lit(False)))
    return rows.withColumn("mark", status_mark(F.col("n_errors"), F.col("has_label"), F.col("dup_group"), F.col("dup_rep"), F.col("n_warns")))


def audit_summary(audited: DataFrame, n_orphans: DataFrame) -> DataFrame:
    """One row of counts. ``n_orphans``: one row with that column."""
    rows = audited.agg(
        F.count(F.lit(1)).alias("images"), F.count_if("has_label").alias("labelled"), F.count_if(~F.col("has_label")).alias("unlabelled"), F.count_if(F.col("n_errors") > 0).alias("with_errors"),
        F.count_if((F.col("n_warns") > 0) & (F.col("n_errors") == 0)).alias("with_warnings"), F.count_if(F.col("dup_rep")).alias("dup_groups"),
        F.count_if(F.col("dup_group").isNotNull() & ~F.col("dup_rep")).alias("dup_surplus"), F.sum("n_boxes").alias("boxes"),
    )
    rows = rows.withColumn("boxes_per_labelled", F.when(F.col("labelled") > 0, F.col("boxes") / F.col("labelled")).otherwise(0.0))
    return rows.crossJoin(n_orphans)  # two single rows


def first_errors(lines: DataFrame, n: int) -> DataFrame:
    """image_id, line_no, first_error of the first ``n`` lines with errors (joined by commas), for a report."""
    parsed = cut(lines.select("image_id", "line_no", "errors"))  # a filter would be pushed down and parse every line again
    rows = parsed.where("errors <> ''").orderBy("image_id", "line_no").limit(n)
    return rows.select("image_id", "line_no", F.split("errors", ",")[0].alias("first_error"))


def in_turn(listing: DataFrame, n: int) -> DataFrame:
    """run (0 to n - 1) and the listed row whose turn it is: ``listing`` (with index from 0) is gone through again and again."""
    size = listing.count()
    runs = listing.sparkSession.range(n if size else 0).select(F.col("id").alias("run"), F.pmod("id", F.lit(max(1, size))).alias("index"))
    return runs.join(listing, "index").drop("index")


#: Which images a view of the audit shows.
AUDIT_VIEWS = {
    "all": "true", "err": "n_errors > 0", "warn": "n_warns > 0 AND n_errors = 0", "nolbl": "NOT has_label", "dup": "dup_group IS NOT NULL", "ok": "mark = '✓'",
}


def audit_view(audited: DataFrame, view: str) -> DataFrame:
    return audited.where(AUDIT_VIEWS[view])


def audit_view_counts(audited: DataFrame) -> DataFrame:
    return audited.agg(*[F.count_if(F.expr(x)).alias(k) for k, x in AUDIT_VIEWS.items()]).unpivot([], list(AUDIT_VIEWS), "view", "n")


def split_eligible(audited: DataFrame, only_labelled: bool = True, drop_copies: bool = True) -> DataFrame:
    """Images that may go into a split: without errors, labelled, and of each duplicate group the first."""
    rows = audited.where("n_errors = 0")
    rows = rows.where("has_label") if only_labelled else rows
    return rows.where("dup_group IS NULL OR dup_rep") if drop_copies else rows


def class_histogram(boxes: DataFrame, names: DataFrame, rare: float = 0.2) -> DataFrame:
    """name, n, percent, bar, rare: boxes by class name (the id where a class has none); ids of one name add up."""
    counts = boxes.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(names.select("cls", "name"), "cls", "left").groupBy(F.coalesce("name", F.col("cls").cast("string")).alias("name")).agg(F.sum("n").alias("n"))
    every = W.partitionBy()  # a row a class
    top, total = F.max("n").over(every), F.sum("n").over(every)
    return named.select("name", "n", (100 * F.col("n") / total).alias("percent"), text_bar(F.col("n"), top).alias("bar"), (F.col("n") < rare * top).alias("rare"))


def missing_classes(boxes: DataFrame, names: DataFrame) -> DataFrame:
    """Declared classes of whose name there is no box."""
    seen = boxes.select("cls").distinct().join(names, "cls").select("name")
    return names.join(seen, "name", "left_anti").select("cls", "name")


def area_histogram(boxes: DataFrame) -> DataFrame:
    """bucket, n, share of normalised boxes by area."""
    rows = boxes.groupBy(area_bucket(F.col("w") * F.col("h")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return rows.select("bucket", "n", share.alias("share"), ((F.col("bucket") == "small") & (share > 0.3)).alias("too_small"))


def boxes_per_image(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """n_boxes, images: how many images have so many boxes, 0 included."""
    counts = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    rows = images.select("image_id").join(counts, "image_id", "left")
    return rows.groupBy(F.coalesce("n", F.lit(0)).alias("n_boxes")).agg(F.count(F.lit(1)).alias("images"))
