"""Streaming queries, drained once over the events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..streaming import models as S
from . import views as V


def _events(spark, sf_dir):
    return S.read_parquet_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _detections(spark, sf_dir):
    return _events(spark, sf_dir).selectExpr(
        "element_at(array('A', 'B', 'C'), cast(user_id % 3 as int) + 1) AS model", "ts", "least(value / 500, 1.0D) AS conf", "value AS infer_ms", "event_type <> 'error' AS found"
    )


def stream_model_stats(spark, sf_dir):
    found = S.run_once(S.model_stats(_detections(spark, sf_dir)), "complete").drop("batch")
    return found.withColumns({c: F.round(c, 6) for c in ("mean_conf", "mean_ms")})


def stream_model_windows(spark, sf_dir):
    """All windows in the order of their updates: the last update of each counts."""
    last = W.partitionBy("model", "start").orderBy(F.col("batch").desc())
    found = S.run_once(S.model_windows(_detections(spark, sf_dir)), "update", lambda df: df.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "batch"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_epoch_dedupe(spark, sf_dir):
    """Epochs reported by each run, once each."""
    reports = _events(spark, sf_dir).selectExpr("concat('r', cast(user_id % 3 as string)) AS run", "cast(floor(event_id / 25) + event_id * 13 % 7 - 2 as int) AS epoch", "300 AS epochs", "ts")
    return S.run_once(S.epoch_dedupe(reports, "3650 days"), "append").select("run", "epoch")


def stream_track_state(spark, sf_dir):
    steps = _events(spark, sf_dir).selectExpr("user_id", "event_id AS frame_no", "1 - (event_id % 100) * 0.0065D AS likeness")
    last = W.partitionBy("user_id").orderBy(F.col("batch").desc())
    return S.run_once(S.track_states(steps), "update", lambda df: df.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k", "batch"))


QUERIES = {f.__name__: f for f in (stream_model_stats, stream_model_windows, stream_epoch_dedupe, stream_track_state)}

ORACLE = {
    "stream_model_stats": f"""WITH {V.DETECTIONS} SELECT model, count(*) AS frames, count(*) FILTER (found) AS detections, round(avg(conf) FILTER (found), 6) AS mean_conf, round(avg(infer_ms), 6) AS mean_ms FROM detections GROUP BY model""",
    "stream_model_windows": f"WITH {V.DETECTIONS} SELECT model, date_trunc('hour', ts) AS start, count(*) AS frames, count(*) FILTER (found) AS detections FROM detections GROUP BY ALL",
    "stream_epoch_dedupe": "SELECT DISTINCT 'r' || (user_id % 3) AS run, (event_id // 25 + event_id * 13 % 7 - 2)::INT AS epoch FROM events WHERE epoch BETWEEN 1 AND 300",
    "stream_track_state": """WITH s AS (SELECT user_id, event_id, 1 - (event_id % 100) * 0.0065::DOUBLE >= 0.4 AS ok FROM events),
f AS (SELECT user_id, min(event_id) FILTER (NOT ok) AS first_lost FROM s GROUP BY user_id)
SELECT user_id, max(event_id) AS frame_no, count(*) FILTER (ok) AS steps, bool_and(ok) AS alive FROM s JOIN f USING (user_id) WHERE first_lost IS NULL OR event_id <= first_lost GROUP BY user_id""",
}
