"""Streams of detections and training reports.

Every function takes a streaming DataFrame; sinks and triggers are the caller's. ``run_once`` drains what is there and
returns the result as a table, for batch use of a streaming plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def read_parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a Parquet folder, or one file, as a stream with the schema found there."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in batch.inputFiles()):  # a stream's path must be a folder
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def model_stats(detections: DataFrame) -> DataFrame:
    """A running row a model: frames with and without detections, mean confidence and time; for complete or update mode."""
    found = F.col("found")
    return detections.groupBy("model").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(found).alias("detections"), F.avg(F.when(found, F.col("conf"))).alias("mean_conf"), F.avg("infer_ms").alias("mean_ms")
    )


def model_windows(detections: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by model and time window; a window closes when the watermark has passed it."""
    rows = detections.withWatermark("ts", late).groupBy("model", F.window("ts", every).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("frames"), F.count_if("found").alias("detections")).select("model", F.col("w.start").alias("start"), "frames", "detections")


def epoch_dedupe(reports: DataFrame, late: str = "1 day") -> DataFrame:
    """Each run's first report of an epoch within its range; state is dropped behind the watermark."""
    return reports.where("epoch <= epochs AND epoch > 0").withWatermark("ts", late).dropDuplicatesWithinWatermark(["run", "epoch"])


def track_states(steps: DataFrame, key: str = "user_id", least: float = 0.40) -> DataFrame:
    """The state of every chain after each batch of its steps (frame_no, likeness): key, frame_no, steps, alive.

    A chain's state is three numbers, whatever its length. It ends at the first step whose likeness is below ``least``.
    """

    def update(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, n, alive = state.get if state.exists else (-1, 0, True)
        rows = sorted((int(f), float(v)) for pdf in parts for f, v in zip(pdf["frame_no"], pdf["likeness"], strict=True))
        for f, v in rows:
            if not alive:
                break
            frame, n, alive = f, n + (v >= least), v >= least
        state.update((frame, int(n), bool(alive)))
        yield pd.DataFrame([(group[0], frame, int(n), bool(alive))], columns=[key, "frame_no", "steps", "alive"])

    kind = dict(steps.dtypes)[key]
    return steps.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, frame_no long, steps long, alive boolean", "frame_no long, steps long, alive boolean", "update", GroupStateTimeout.NoTimeout)


def skip_existing(batch: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """For ``foreachBatch``: the rows whose output isn't there yet."""
    return batch.join(done, on, "left_anti")


def run_once(stream: DataFrame, mode: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What the stream gives when all input that is there has passed, as a table in the shared folder.

    ``complete`` keeps the last batch's table; ``append`` and ``update`` keep every batch under its own number, so a batch
    that runs again replaces itself. ``keep`` reduces the batches to the result.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        at = 0 if mode == "complete" else number
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={at}")

    query = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return keep(spark.read.parquet(f"{folder}/rows"))

