"""Boxes carried along frames: labels propagated until a stop, and chains checked against their first frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import chain_confidence

#: Least likeness to the first frame's patch, and least confidence of a step.
LIKENESS, STEP = 0.40, 0.35
# Least number of good points, largest error of a point that is followed back, range of scales, least side.
POINTS, BACK, SCALES, LEAST_SIDE = 6, 2.0, (0.75, 1.35), 4


def take_while(frames: DataFrame, keys: list[str], order: str, stop: str, most: int | None = None) -> DataFrame:
    """Frames before each key's first one with ``stop``; at most ``most`` of them.

    The first stop is an aggregate with partial results; ``most`` is a row number that Spark limits before the shuffle.
    """
    first = frames.where(F.col(stop)).groupBy(*keys).agg(F.min(order).alias("_first"))
    rows = frames.join(first, keys, "left").where(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")
    if most is None:
        return rows
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_k") <= most).drop("_k")


def chain_scores(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Steps (flow and likeness by frame) of chains up to the first that lost its object, with confidence and step number."""
    rows = steps.withColumn("_lost", F.col("flow").isNull() | (F.col("likeness") < LIKENESS))
    kept = take_while(rows, keys, order, "_lost").drop("_lost")
    number = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return kept.withColumn("step", number.cast("int")).withColumn("confidence", chain_confidence(F.col("flow"), F.col("likeness")))


def accepted_steps(points: DataFrame, steps: DataFrame, keys: list[str]) -> DataFrame:
    """``steps`` (keys, scale, width, height of the carried box) with n_good, scale and accepted.

    ``points``: keys, found (followed there and back) and back (how far from its start it came back, in pixels). A step
    needs POINTS good points and a box of LEAST_SIDE pixels; a scale outside SCALES counts as none.
    """
    good = points.groupBy(*keys).agg(F.count_if(F.col("found") & (F.col("back") < BACK)).alias("n_good"))
    rows = steps.join(good, keys, "left").withColumn("n_good", F.coalesce("n_good", F.lit(0)))
    rows = rows.withColumn("scale", F.when(F.col("scale").between(*SCALES), F.col("scale")).otherwise(1.0))
    return rows.withColumn("accepted", (F.col("n_good") >= POINTS) & (F.least("width", "height") >= LEAST_SIDE))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Normalised cross-correlation of two grey patches; 0 if one is empty or flat."""
    if a.size == 0 or a.shape != b.shape:
        return 0.0
    a, b = a.astype(float) - a.mean(), b.astype(float) - b.mean()
    norm = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / norm) if norm > 0 else 0.0


def track(frames: DataFrame, step: Callable[[object, object, tuple], tuple[tuple | None, float]], key: str = "clip_id") -> DataFrame:
    """Boxes carried through each clip by ``step(previous, next, box) -> (box or None, confidence)``.

    ``frames``: the key, frame_no, content and box (array<double>, set on frames labelled by hand). A clip's frames pass in
    order, a batch of a partition at a time, so no clip is held as a whole; the chain starts at a labelled frame and ends
    where the box is lost or the next one stands. A ``step`` that has a method ``start(content, box)`` is told of each
    labelled frame; every task has a copy of its own. A clip is one key and passes through one task.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, box, last, start = object(), None, None, getattr(step, "start", None)
        for pdf in parts:
            out = []
            for own, frame_no, content, drawn in zip(pdf[key], pdf["frame_no"], pdf["content"], pdf["box"], strict=True):
                if own != clip:
                    clip, box, last = own, None, None
                if drawn is not None:
                    box = tuple(drawn)
                    if start is not None:
                        start(content, box)
                elif box is not None:
                    box, confidence = step(last, content, box)
                    if box is not None and confidence < STEP:
                        box = None
                    if box is not None:
                        out.append((own, frame_no, *map(float, box), float(confidence)))
                last = content
            yield pd.DataFrame(out, columns=[key, "frame_no", "x1", "y1", "x2", "y2", "confidence"])

    kind = dict(frames.dtypes)[key]
    ordered = frames.select(key, "frame_no", "content", "box").repartition(key).sortWithinPartitions(key, "frame_no")
    return ordered.mapInPandas(run, f"{key} {kind}, frame_no long, x1 double, y1 double, x2 double, y2 double, confidence double")
