"""Which label belongs to which image: equi-joins on stems and paths in four orders of preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stem

#: Label files that are no labels.
NOT_LABELS = ("classes.txt",)


def by_stem(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``images`` (stem and more) with label_path, or null: a flat label folder. Images of one stem share a label."""
    one = labels.groupBy("stem").agg(F.min("path").alias("label_path"))
    return images.join(one, "stem", "left")


def by_relative_path(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``images`` (rel_dir, stem and more) with label_path, or null: label folders mirror image folders."""
    one = labels.groupBy("rel_dir", "stem").agg(F.min("path").alias("label_path"))
    return images.join(one, ["rel_dir", "stem"], "left")


def flat_then_nested(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``images`` with label_path: the flat label of the stem, else the one in the mirrored folder."""
    flat = labels.where("rel_dir = ''").groupBy("stem").agg(F.min("path").alias("_flat"))
    nested = labels.where("rel_dir <> ''").groupBy("rel_dir", "stem").agg(F.min("path").alias("_nested"))
    rows = images.join(flat, "stem", "left").join(nested, ["rel_dir", "stem"], "left")
    return rows.withColumn("label_path", F.coalesce("_flat", "_nested")).drop("_flat", "_nested")


def candidate_paths(path: Column, root: str) -> Column:
    """Where an editor looks for an image's label, in order, each place once."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    parent = F.regexp_replace(folder, "/[^/]*$", "")
    name = F.concat(stem(path), F.lit(".txt"))
    rest = F.regexp_replace(F.substring(path, len(root) + 2, F.length(path)), r"\.[^./]*$", ".txt")
    above = root.rstrip("/").rsplit("/", 1)[0]

    def at(*parts: Column | str) -> Column:
        return F.concat_ws("/", *[x if isinstance(x, Column) else F.lit(x) for x in parts])

    return F.array_distinct(F.array(at(root, "labels", rest), at(folder, name), at(folder, "labels", name), at(parent, "labels", name), at(above, "labels", rest)))


def by_candidates(images: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """``images`` (image_id, path) with label_path: the first candidate that exists and isn't empty.

    ``labels``: path, length. Candidates are dealt to their own paths, so the join is on equality; the best is picked by
    an aggregate with partial results, not by a sort.
    """
    places = images.select("image_id", F.posexplode(candidate_paths(F.col("path"), root)).alias("rank", "label_path"))
    there = places.join(labels.where("length > 0").select(F.col("path").alias("label_path")), "label_path", "left_semi")
    best = there.groupBy("image_id").agg(F.min_by("label_path", "rank").alias("label_path"), F.min("rank").cast("int").alias("rank"))
    return images.join(best, "image_id", "left")


def orphans(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels without an image of their stem."""
    rows = labels.where(~F.regexp_extract("path", "([^/]*)$", 1).isin(*NOT_LABELS))
    return rows.join(images.select("stem"), "stem", "left_anti")


def to_do(images: DataFrame, done: DataFrame, on: str | Sequence[str] = "stem") -> DataFrame:
    """Images whose output isn't there yet."""
    return images.join(done, on, "left_anti")


def newly_added(paths: DataFrame, listed: DataFrame, order: str) -> DataFrame:
    """Of ``paths`` (path and more) those that ``listed`` doesn't hold, each once: its first row by ``order``. Null paths go."""
    fresh = paths.where("path IS NOT NULL").join(listed.select("path"), "path", "left_anti")
    first = F.min_by(F.struct(*[F.col(c) for c in paths.columns if c != "path"]), F.col(order)).alias("_row")
    return fresh.groupBy("path").agg(first).select("path", "_row.*").select(*paths.columns)


def existing(records: DataFrame, images: DataFrame) -> DataFrame:
    """Records whose image file is there."""
    return records.join(images.select("path"), "path", "left_semi")
