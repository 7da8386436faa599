"""Splits that never tear a group apart, and the check for groups on both sides."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

NAMES = ("train", "val", "test")
#: Groups that one task fills in order before the next one goes on from its sums. The result does not depend on it.
BLOCK_GROUPS = 100_000
#: Up to so many group keys may pass through the driver for ``order="python"``.
PYTHON_KEYS = 1_000_000


def _fill(room: list[float], sizes: Iterable[int]) -> Iterator[int]:
    """The number of each group's part in turn: the one with most room, the first of equals. ``room`` is kept up to date."""
    for n in sizes:
        part = room.index(max(room))
        room[part] -= n
        yield part


def _filled_in_order(ranked: DataFrame, ratios: Sequence[float], slice_groups: int) -> DataFrame:
    """``ranked`` (key, n, rank) with the part that one pass in order of rank and key gives each group.

    Groups are dealt to slices by range. Slices take turns to sum up what they fill, starting from the sums of the slice
    before; then all slices fill side by side, each from its own start.
    """
    count, total = ranked.agg(F.count(F.lit(1)), F.sum("n")).first()
    wanted = [name for name, r in zip(NAMES, ratios, strict=True) if r > 0] or ["train"]
    room = [ratios[NAMES.index(name)] * (total or 0) for name in wanted]
    slices = -(-count // slice_groups) or 1
    placed = cut(ranked.repartitionByRange(slices, "rank", "key").sortWithinPartitions("rank", "key").withColumn("slice", F.spark_partition_id()))
    sizes, starts = placed.select("n").rdd, [room]

    def after(start: list[float]):
        def run(rows: Iterable) -> list[list[float]]:
            left = list(start)
            deque(_fill(left, (r.n for r in rows)), maxlen=0)
            return [left]

        return run

    for k in range(sizes.getNumPartitions() - 1):
        starts += ranked.sparkSession.sparkContext.runJob(sizes, after(starts[-1]), [k])

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for pdf in parts:
            if len(pdf):
                left = left or list(starts[pdf["slice"].iat[0]])
                yield pdf[["key", "n", "rank"]].assign(split=[wanted[k] for k in _fill(left, pdf["n"].tolist())])

    return placed.mapInPandas(fill, "key string, n long, rank string, split string")


def assign_splits(keys: DataFrame, ratios: Sequence[float] = (0.8, 0.2, 0.0), seed: int = 42, order: str = "md5", block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """key, n, split: every group goes to the part that is farthest below its target when its turn comes.

    ``keys``: key of every row, or key and n. Turns: ``md5`` sorts groups by the MD5 of seed and key and works at any
    size; ``python`` shuffles the sorted keys with Python's generator, for up to PYTHON_KEYS groups. A task fills about
    ``block_groups`` groups and hands its sums on, so the rule is that of one pass at any size. If a validation part was
    asked for and stays empty, it gets the smallest training group.
    """
    ratios = [r / (sum(ratios) or 1) for r in ratios]
    groups = keys.groupBy("key").agg((F.sum("n") if "n" in keys.columns else F.count(F.lit(1))).alias("n"))
    if order == "python":
        known = sorted(r.key for r in groups.select("key").limit(PYTHON_KEYS + 1).collect())
        if len(known) > PYTHON_KEYS:
            raise ValueError(f"order='python' is for up to {PYTHON_KEYS} groups; use order='md5'")
        random.Random(seed).shuffle(known)
        places = keys.sparkSession.createDataFrame([(k, f"{i:08d}") for i, k in enumerate(known)], "key string, rank string")
        ranked = groups.join(places, "key")
    else:
        ranked = groups.withColumn("rank", F.md5(F.concat_ws("|", F.lit(str(seed)), "key").cast("binary")))
    filled = cut(_filled_in_order(cut(ranked), ratios, block_groups))
    if ratios[1] > 0 and filled.where("split = 'val'").isEmpty():
        lent = filled.where("split = 'train'").agg(F.min_by("key", F.struct("n", "rank", "key"))).first()[0]
        filled = filled.withColumn("split", F.when(F.col("key").eqNullSafe(F.lit(lent)) & (F.col("split") == "train"), "val").otherwise(F.col("split")))
    return filled.select("key", "n", "split")


def split_stats(assigned: DataFrame, boxes: DataFrame, names: DataFrame) -> DataFrame:
    """split, name, images, n: boxes of each class in each part, 0 included. ``assigned``: image_id, split; ``boxes``: image_id, cls."""
    images = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("images"))
    counts = assigned.join(boxes, "image_id").groupBy("split", "cls").agg(F.count(F.lit(1)).alias("n"))
    every = images.crossJoin(names.select("cls", "name"))  # parts x classes
    return every.join(counts, ["split", "cls"], "left").select("split", "name", "images", F.coalesce("n", F.lit(0)).alias("n"))


def leaking_groups(groups: DataFrame, sides: DataFrame, left: str = "train", right: str = "val") -> DataFrame:
    """dup_group, n_left, n_right, first_left, first_right of groups on both sides. ``groups``: id, dup_group; ``sides``: id, split."""
    rows = groups.join(sides.hint("merge"), "id").where(F.col("split").isin(left, right))
    of = {"left": F.col("split") == left, "right": F.col("split") == right}
    sums = rows.groupBy("dup_group").agg(*[F.count_if(x).alias(f"n_{k}") for k, x in of.items()], *[F.min(F.when(x, F.col("id"))).alias(f"first_{k}") for k, x in of.items()])
    return sums.where("n_left > 0 AND n_right > 0")


def leak_gate(n_left: int, n_right: int, n_leaking: int, error: str = "", cancelled: bool = False) -> tuple[str, str]:
    """What to do before a training: (stop, ask or continue, why)."""
    if cancelled:
        return "stop", "cancelled"
    if error:
        return "ask", error
    if not n_left or not n_right:
        return "continue", "a part is empty, the check was skipped"
    return ("ask", f"{n_leaking} groups leak") if n_leaking else ("continue", "no leak")
