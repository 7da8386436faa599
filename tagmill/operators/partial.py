"""Long work in slices that can be cancelled from outside and then gives what was whole by then."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


@dataclass(frozen=True)
class Partial:
    """Rows of the slices that were whole, their numbers, and whether the work was cancelled."""

    rows: DataFrame
    done: tuple[int, ...]
    slices: int
    cancelled: bool


class Sliced:
    """Runs ``work(slice of rows)`` for one slice of ``rows`` after the other, each a distributed job.

    A row's slice is the hash of its ``key``, so what belongs to one key is in one slice; work that groups by the key or by
    more gives the same rows as over the whole. Each slice is written to the shared folder as a table of its own and counts
    once that table is committed. ``cancel`` may be called from any thread: running jobs are stopped by their tag, the slice
    they were at leaves nothing, and no further one begins. The rows are read once for each slice, but for tables that are
    partitioned by ``slice_of``.
    """

    def __init__(self, spark: SparkSession, slices: int = 16):
        if slices < 1:
            raise ValueError("one slice or more")
        self.spark, self.slices, self.tag = spark, slices, f"sliced-{uuid.uuid4().hex}"
        self.folder = f"{shared_folder(spark).rstrip('/')}/{self.tag}"
        self._stop = Event()

    def cancel(self) -> None:
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> Partial:
        done, sc, schema = [], self.spark.sparkContext, work(rows.limit(0)).schema
        sc.addJobTag(self.tag)
        try:
            for k in range(self.slices):
                if self._stop.is_set():
                    break
                part = work(rows.where(F.pmod(F.xxhash64(key), F.lit(self.slices)) == k))
                try:
                    part.write.mode("overwrite").parquet(f"{self.folder}/slice-{k}")
                except Exception:
                    if self._stop.is_set():  # the job was stopped, and nothing of this slice is committed
                        break
                    raise
                done.append(k)
        finally:
            sc.removeJobTag(self.tag)
        paths = [f"{self.folder}/slice-{k}" for k in done]
        found = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return Partial(found, tuple(done), self.slices, len(done) < self.slices)
