"""Batch labelling with a model: inference as a pluggable step, and what a run reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PRED


def predict(images: DataFrame, predictor: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``predictor`` over Arrow batches of images; it returns rows of ``schemas.PRED`` and is built once a worker by the caller."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield predictor(pdf)

    return images.mapInPandas(run, PRED)


def filter_classes(pred: DataFrame, classes: Sequence[int] | None = None, least_conf: float = 0.0) -> DataFrame:
    """Predictions of the given classes (None: all) with enough confidence."""
    out = pred.where(F.col("conf") >= least_conf)
    return out if classes is None else out.where(F.col("cls").isin(list(classes)))


def normal_selection(chosen: Sequence[int], known: Sequence[int]) -> tuple[list[int] | None, list[int]]:
    """The class filter (None if all known ones are chosen) and the chosen ids that the model doesn't know."""
    good = sorted(set(chosen) & set(known))
    return (None if set(good) == set(known) else good), sorted(set(chosen) - set(known))


def selections(chosen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, classes, unknown: ``normal_selection`` for many keys at once, from rows (key, cls) of both; keys are those of ``known``.

    classes is null where all known ones are chosen, as no filter is needed then; nulls among classes are ignored.
    """

    def sets(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_set("cls")).alias(name))

    both = sets(known, "_known").join(sets(chosen, "_chosen"), key, "left").withColumn("_chosen", F.coalesce("_chosen", F.array().cast("array<int>")))
    good = F.array_intersect("_known", "_chosen")
    return both.select(key, F.when(F.size(good) < F.size("_known"), good).alias("classes"), F.array_except("_chosen", "_known").alias("unknown"))


def autolabel_summary(images: DataFrame, pred: DataFrame, classes: Sequence[int] | None = None, least_conf: float = 0.0) -> DataFrame:
    """what, cls, n: images processed, with and without detections, detections, and detections of each class (cls -1: all)."""
    found = filter_classes(pred, classes, least_conf)
    by_image = found.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    rows = images.select("image_id").distinct().join(by_image, "image_id", "left")
    names = {"processed": F.count(F.lit(1)), "with detections": F.count("n"), "without detections": F.count_if(F.col("n").isNull()), "detections": F.coalesce(F.sum("n"), F.lit(0))}
    counts = rows.agg(*[x.alias(k) for k, x in names.items()]).unpivot([], list(names), "what", "n")
    classes_seen = found.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).select(F.lit("class").alias("what"), "cls", "n")
    return counts.select("what", F.lit(-1).alias("cls"), "n").unionByName(classes_seen)
