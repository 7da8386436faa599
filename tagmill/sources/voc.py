"""VOC files: one XML annotation each, read by Spark's XML source with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators.remap import first_seen_ids
from ..schemas import VOC


def read_voc(spark: SparkSession, root: str) -> DataFrame:
    """A row a file below ``root``: source_file, filename, folder, width, height, objects. Files that are no XML are left out.

    A file without a file name stands for the image of its own stem.
    """
    schema = f"folder string, {VOC}, _corrupt_record string"
    rows = spark.read.schema(schema).option("rowTag", "annotation").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").xml(root)
    path = F.col("_metadata.file_path")
    name = F.when(F.coalesce(F.trim("filename"), F.lit("")) != "", F.trim("filename")).otherwise(F.concat(stem(path), F.lit(".jpg")))
    return rows.where("_corrupt_record IS NULL").select(
        path.alias("source_file"), name.alias("filename"), F.trim("folder").alias("folder"), F.coalesce("size.width", F.lit(0)).alias("width"), F.coalesce("size.height", F.lit(0)).alias("height"), F.col("object").alias("objects")
    )


def objects_of(voc: DataFrame) -> DataFrame:
    """source_file, filename, width, height, pos, name, box, flagged of every named object."""
    rows = voc.select("source_file", "filename", "width", "height", F.posexplode("objects").alias("pos", "o")).where(F.coalesce(F.trim("o.name"), F.lit("")) != "")
    return rows.select("source_file", "filename", "width", "height", "pos", F.trim("o.name").alias("name"), F.col("o.bndbox").alias("box"), (F.coalesce("o.difficult", F.lit(0)) == 1).alias("flagged"))


def classes_of(voc: DataFrame) -> DataFrame:
    """cls, name: ids by first encounter over files in order of path, objects in order."""
    return first_seen_ids(objects_of(voc), "name", "source_file", "pos").select(F.col("id").alias("cls"), "name")


def boxes_of(voc: DataFrame) -> DataFrame:
    """Boxes in raw form: image_id (the file name), width, height, src_cls, x, y, w, h, flagged; without four corners no box."""
    rows = objects_of(voc).join(classes_of(voc), "name")
    b = {k: F.col(f"box.{k}") for k in ("xmin", "ymin", "xmax", "ymax")}
    some = b["xmin"].isNotNull() & b["ymin"].isNotNull() & b["xmax"].isNotNull() & b["ymax"].isNotNull()
    return rows.where(some).select(F.col("filename").alias("image_id"), "width", "height", F.col("cls").alias("src_cls"), b["xmin"].alias("x"), b["ymin"].alias("y"), (b["xmax"] - b["xmin"]).alias("w"), (b["ymax"] - b["ymin"]).alias("h"), "flagged")


def guess_format(spark: SparkSession, root: str) -> str:
    """voc or coco, by the first folder from ``root`` down with XML or JSON files; XML comes before JSON. Else nothing."""
    from .files import list_files

    found = list_files(spark, root, ("xml", "json")).groupBy("rel_dir").agg(F.max("ext").alias("ext"))
    first = found.orderBy(F.split("rel_dir", "/")).select("ext").first()
    return {None: "", "xml": "voc", "json": "coco"}[first and first.ext]
