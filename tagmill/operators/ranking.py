"""Ranking of images for labelling: those whose predictions are least certain first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import uncertainty


def active_scores(images: DataFrame, pred: DataFrame, low: float = 0.25, high: float = 0.70, empty_bonus: float = 1.0) -> DataFrame:
    """image_id, n_box, n_band, max_conf, score for every image of the pool.

    The score adds up the uncertainty of the predictions with a confidence in [low, high]; an image without any
    prediction gets ``empty_bonus``, as something may have been missed.
    """
    if low >= high:
        raise ValueError("low must be below high")
    band = F.col("conf").between(low, high)
    some = pred.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_box"), F.count_if(band).alias("n_band"), F.max("conf").alias("max_conf"),
        F.sum(F.when(band, uncertainty(F.col("conf").cast("decimal(18,6)"))).otherwise(0)).cast("double").alias("score"),
    )
    rows = images.select("image_id").join(some, "image_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "image_id", F.coalesce("n_box", zero).alias("n_box"), F.coalesce("n_band", zero).alias("n_band"), F.coalesce("max_conf", F.lit(0.0)).alias("max_conf"),
        F.coalesce("score", F.lit(float(empty_bonus))).alias("score"),
    )


def active_rank(scores: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` images to label first."""
    return scores.orderBy(F.col("score").desc(), "image_id").limit(n)


def active_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("n_band") > 0).alias("uncertain"), F.count_if(F.col("n_box") == 0).alias("empty"))
