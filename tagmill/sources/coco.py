"""COCO files: one JSON document each, with images, annotations and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COCO


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: source_file, images, annotations, categories. Files that can't be read as JSON, or hold no images, are left out."""
    rows = spark.read.schema(f"{COCO}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select(F.col("_metadata.file_path").alias("source_file"), "images", "annotations", "categories").where("images IS NOT NULL")


def images_of(coco: DataFrame) -> DataFrame:
    """source_file, id, file_name, filename, width, height; of images of one id the last counts."""
    rows = coco.select("source_file", F.posexplode("images")).select("source_file", "pos", "col.*").where("id IS NOT NULL")
    last = rows.groupBy("source_file", "id").agg(F.max_by(F.struct("file_name", "filename", "width", "height"), "pos").alias("x"))
    return last.select("source_file", "id", "x.*")


def classes_of(coco: DataFrame) -> DataFrame:
    """source_file, cls, name (the id where there is no name)."""
    rows = coco.select("source_file", F.inline("categories")).where("id IS NOT NULL")
    return rows.select("source_file", F.col("id").alias("cls"), F.coalesce("name", F.col("id").cast("string")).alias("name"))


def annotations_of(coco: DataFrame) -> DataFrame:
    return coco.select("source_file", F.inline("annotations"))


def boxes_of(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Boxes in raw form: image_id, path, width, height, src_cls, x, y, w, h, flagged.

    Annotations without image, class or four numbers are left out, as are those of unknown images or images without a
    name. Where both frames have source_file, ids hold within a file.
    """
    keys = ["source_file"] if "source_file" in images.columns else []
    good = F.col("image_id").isNotNull() & F.col("category_id").isNotNull() & (F.size("bbox") >= 4) & F.forall(F.slice("bbox", 1, 4), lambda v: v.isNotNull())
    path = F.coalesce(F.when(F.col("file_name") != "", F.col("file_name")), F.when(F.col("filename") != "", F.col("filename")))
    named = images.select(*keys, F.col("id").alias("image_id"), path.alias("path"), F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height")).where("path IS NOT NULL")
    rows = annotations.where(good).join(named, [*keys, "image_id"])
    sides = [F.get("bbox", F.lit(i)).alias(k) for i, k in enumerate("xywh")]
    return rows.select(*keys, "image_id", "path", "width", "height", F.col("category_id").cast("int").alias("src_cls"), *sides, (F.coalesce("iscrowd", F.lit(0)) != 0).alias("flagged"))
