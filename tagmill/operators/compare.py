"""Comparison of models on videos, benchmarks and training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .numbering import order_statistics


def model_stats(detections: DataFrame) -> DataFrame:
    """A row a model: frames, detections, per_frame, empty_share, mean_conf, mean_ms, fps, errors.

    ``detections``: model, video_id, frame_no, found, conf, infer_ms: a row a detection, or a row with found = false for
    a frame without one; infer_ms null marks a failed call. Counted by frame, then by model.
    """
    frames = detections.groupBy("model", "video_id", "frame_no").agg(
        F.count_if("found").alias("n"), F.sum(F.when(F.col("found"), F.col("conf"))).alias("conf"), F.max("infer_ms").alias("ms")
    )
    rows = frames.groupBy("model").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("n").alias("detections"), F.count_if(F.col("n") > 0).alias("_full"), F.sum("conf").alias("_conf"), F.sum("ms").alias("_ms"), F.count_if(F.col("ms").isNull()).alias("errors")
    )
    n, ms = F.greatest(F.col("frames"), F.lit(1)), F.coalesce("_ms", F.lit(0.0)) / F.greatest(F.col("frames"), F.lit(1))
    return rows.select(
        "model", "frames", "detections", (F.col("detections") / n).alias("per_frame"), (1 - F.col("_full") / n).alias("empty_share"),
        F.when(F.col("detections") > 0, F.col("_conf") / F.col("detections")).otherwise(0.0).alias("mean_conf"), ms.alias("mean_ms"), F.when(ms > 0, 1000 / ms).otherwise(0.0).alias("fps"), "errors",
    )


def class_distribution(detections: DataFrame) -> DataFrame:
    return detections.where("found").groupBy("model", "cls").agg(F.count(F.lit(1)).alias("n"))


def highlights(stats: DataFrame) -> DataFrame:
    """what, model, value: the model with most detections, frames a second and confidence; the first by name of equals."""
    def best(measure: str) -> Column:
        return F.min_by("model", F.struct(-F.col(measure), F.col("model"))).alias(measure)

    names = ("detections", "fps", "mean_conf")
    top = stats.agg(*[best(m) for m in names]).unpivot([], list(names), "what", "model")
    values = stats.select("model", *[F.col(m).cast("double").alias(m) for m in names]).unpivot(["model"], list(names), "what", "value")
    return top.join(values, ["what", "model"]).select("what", "model", "value")


def class_sets(model_classes: DataFrame) -> DataFrame:
    """model, n, only_here (a name list), common (names that all models know), same (whether all sets are equal)."""
    sets = model_classes.groupBy("model").agg(F.array_sort(F.collect_set("name")).alias("names"))
    every = W.partitionBy()  # a row a model
    all_sets = F.collect_list("names").over(every)
    common = F.aggregate(all_sets, F.get(all_sets, F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    rows = sets.withColumn("c", common).withColumn("same", F.size(F.collect_set("names").over(every)) == 1)
    return rows.select("model", F.size("names").alias("n"), F.array_join(F.array_except("names", "c"), ",").alias("only_here"), F.array_join(F.array_sort("c"), ",").alias("common"), "same")


def bench_stats(timings: DataFrame) -> DataFrame:
    """model, n, pre, infer, post, total (means), median, p95, fps. ``timings``: model, pre, infer, post, total in ms."""
    means = timings.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("pre", "infer", "post", "total")])
    ranks = order_statistics(timings, "model", "total")
    return means.join(ranks, "model").withColumn("fps", F.when(F.col("total") > 0, 1000 / F.col("total")).otherwise(0.0))


def speed_up(stats: DataFrame, base: str, camera_fps: float = 2.0) -> DataFrame:
    """model, speed_up against the model ``base``, cameras that one process can serve."""
    first = stats.where(F.col("model") == base).select(F.col("total").alias("_base"))
    rows = stats.crossJoin(first)  # one row
    return rows.select("model", F.when(F.col("total") > 0, F.col("_base") / F.col("total")).otherwise(0.0).alias("speed_up"), (F.col("fps") / camera_fps).alias("cameras"))


def monotone_epochs(epochs: DataFrame) -> DataFrame:
    """Reports of a run (run, seq, epoch, epochs and more) whose epoch is a new highest one, at most ``epochs``.

    That is a run's first report of an epoch if none of a higher epoch came before it. So reports are first reduced to
    one for each epoch, and the window passes over a run's epochs, however often each was reported.
    """
    rest = [c for c in epochs.columns if c not in ("run", "epoch")]
    firsts = epochs.where("epoch <= epochs AND epoch > 0").groupBy("run", "epoch").agg(F.min_by(F.struct(*rest), "seq").alias("x"))
    higher = F.min("x.seq").over(W.partitionBy("run").orderBy(F.col("epoch").desc()).rowsBetween(W.unboundedPreceding, -1))
    rows = firsts.withColumn("_higher", higher).where(F.col("_higher").isNull() | (F.col("x.seq") < F.col("_higher")))
    return rows.select("run", "epoch", "x.*").select(*epochs.columns)


def best_epoch(epochs: DataFrame) -> DataFrame:
    """run, best_epoch (highest map, the first of equals), best_map, last_epoch, last_loss, last_map."""
    best = F.min_by(F.struct("epoch", "map"), F.struct(-F.coalesce("map", F.lit(-1.0)), F.col("epoch")))
    last = F.max_by(F.struct("epoch", "loss", "map"), "epoch")
    rows = epochs.groupBy("run").agg(best.alias("b"), last.alias("l"))
    return rows.select("run", F.col("b.epoch").alias("best_epoch"), F.col("b.map").alias("best_map"), F.col("l.epoch").alias("last_epoch"), F.col("l.loss").alias("last_loss"), F.col("l.map").alias("last_map"))


def total_loss(items: Column) -> Column:
    """The sum of a map of loss items without the missing ones."""
    return F.aggregate(F.map_values(items), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def first_metric(metrics: Column, name: str) -> Column:
    """A metric by its first known alias: boxes, poses, masks."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(f"metrics/{name}({kind})")) for kind in "BPM"])
