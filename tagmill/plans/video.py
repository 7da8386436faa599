"""Models on videos, benchmarks, training runs, durations and frame arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefmt as D
from ..operators import compare as C
from ..operators import tracking as T
from ..operators.numbering import systematic_sample
from . import views as V


def _rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


def compare_model_stats(spark, sf_dir):
    return _rounded(C.model_stats(V.detections(spark, sf_dir)), "per_frame", "empty_share", "mean_conf", "mean_ms", "fps")


def compare_class_dist(spark, sf_dir):
    return C.class_distribution(V.detections(spark, sf_dir))


def compare_highlights(spark, sf_dir):
    return _rounded(C.highlights(C.model_stats(V.detections(spark, sf_dir))), "value")


def _model_classes(spark, sf_dir):
    """The part types that each brand's last digit knows."""
    parts = V.table(spark, sf_dir, "part").where("p_partkey % 37 < 9")
    return parts.select(F.concat(F.lit("m"), F.expr("p_partkey % 3").cast("string")).alias("model"), F.concat_ws(" ", "p_type", F.expr("p_size % 4").cast("string")).alias("name")).where("NOT (model = 'm1' AND name LIKE 'E%') AND NOT (model = 'm2' AND name LIKE '%3')")


def compare_class_sets(spark, sf_dir):
    return C.class_sets(_model_classes(spark, sf_dir))


def frame_window_stride(spark, sf_dir):
    """Frames of five videos within 2 to 90 s, one for each fifth of a second."""
    e = V.detections(spark, sf_dir).select("video_id", "frame_no").withColumn("fps", F.element_at(F.array(*[F.lit(x) for x in (25.0, 30.0, 12.5, 24.0, 29.97)]), F.col("video_id").cast("int") + 1))
    total = e.groupBy("video_id").agg((F.max("frame_no") + 1).alias("total"))
    rows = e.join(total, "video_id")
    window = D.frame_window(F.lit(2000), F.lit(90000), F.col("fps"), F.col("total"), F.lit(5.0))
    rows = rows.withColumns(window)
    return rows.where("frame_no >= first_frame AND frame_no < end_frame AND (frame_no - first_frame) % stride = 0").select("video_id", "frame_no", "stride", F.round("out_fps", 6).alias("out_fps"))


def frame_estimate(spark, sf_dir):
    """Estimates for the durations in ``events``: valid ranges, ranges that end before they start, no range."""
    e = V.table(spark, sf_dir, "events")
    start = F.when(F.expr("event_id % 4 < 3"), (F.col("event_id") % 7) * 1000)
    end = F.when(F.expr("event_id % 4 < 2"), start + 500 + (F.col("event_id") % 11) * 300).when(F.expr("event_id % 4 = 2"), start - 100)
    w = D.frame_window(start, end, F.lit(25.0), F.lit(400).cast("long"), (F.col("user_id") % 9).cast("double"))
    return e.select("event_id", w["first_frame"].alias("first_frame"), w["end_frame"].alias("end_frame"), w["stride"].alias("stride"), w["estimate"].alias("estimate"))


def _timings(spark, sf_dir):
    total = F.col("value")
    return V.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (total * 0.125).alias("pre"), (total * 0.75).alias("infer"), (total * 0.125).alias("post"), total.alias("total"))


def bench_stats(spark, sf_dir):
    return _rounded(C.bench_stats(_timings(spark, sf_dir)), "pre", "infer", "post", "total", "median", "p95", "fps")


def bench_speedup_capacity(spark, sf_dir):
    return _rounded(C.speed_up(C.bench_stats(_timings(spark, sf_dir)), "view"), "speed_up", "cameras")


def _epochs(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("epoch", F.datediff(F.col("ts").cast("date"), F.lit("2023-12-31").cast("date")))
    sums = e.groupBy(F.concat(F.lit("r"), F.expr("user_id % 3").cast("string")).alias("run"), "epoch").agg(F.avg("value").alias("loss"), F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("map"))
    return sums


def epoch_best(spark, sf_dir):
    return _rounded(C.best_epoch(_epochs(spark, sf_dir)), "best_map", "last_loss", "last_map")


def _reports(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.selectExpr("concat('r', cast(user_id % 3 as string)) AS run", "event_id AS seq", "cast(floor(event_id / 25) + event_id * 13 % 7 - 2 as int) AS epoch", "300 AS epochs", "value AS loss")


def epoch_monotone(spark, sf_dir):
    return C.monotone_epochs(_reports(spark, sf_dir))


def epoch_metrics(spark, sf_dir):
    """Loss items and metric aliases of each event's report."""
    e = V.table(spark, sf_dir, "events")
    items = F.create_map(F.lit("box"), F.col("value"), F.lit("cls"), F.when(F.expr("event_id % 3 <> 0"), F.lit(1.5)), F.lit("dfl"), F.lit(0.25))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("metrics/mAP50(B)", "metrics/mAP50(P)", "metrics/mAP50(M)", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    metrics = F.create_map(kind, F.col("user_id") / 1000)
    return e.select("event_id", F.round(C.total_loss(items), 6).alias("loss"), F.round(C.first_metric(metrics, "mAP50"), 6).alias("map50"))


def track_chain_scores(spark, sf_dir):
    """Chains by user: flow and likeness derived from the events; a chain ends where the object is lost."""
    e = V.table(spark, sf_dir, "events")
    steps = e.select("user_id", "event_id", F.when(F.expr("event_id % 29 <> 0"), 1 - F.col("value") / 2003).alias("flow"), F.expr("1 - (event_id % 100) * 0.0065D").alias("likeness"))
    return _rounded(T.chain_scores(steps, ["user_id"], "event_id").select("user_id", "event_id", "step", "confidence"), "confidence")


def drift_sample(spark, sf_dir):
    """The systematic sample that a leak check with a limit would read of each side."""
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return systematic_sample(o, 4000, "o_orderkey")


def ms_format(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7919 - 5000).alias("ms"))
    return e.select("event_id", D.ms_to_clock(F.col("ms")).alias("clock"), D.frame_ms(F.col("event_id") % 61).alias("frame_ms"))


def ffmpeg_time(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 104729 - 5000).alias("ms"))
    return e.select("event_id", D.ms_to_ffmpeg(F.col("ms")).alias("clock"))


#: Durations as text, right and wrong, in both dialects.
_TEXTS = """CASE event_id % 12 WHEN 0 THEN cast(event_id % 90 as string) WHEN 1 THEN cast(event_id % 90 as string) || '.' || cast(event_id % 1000 as string)
  WHEN 2 THEN cast(event_id % 50 as string) || ':' || cast(user_id % 60 as string) || ',' || cast(event_id % 10 as string)
  WHEN 3 THEN '1:' || cast(event_id % 60 as string) || ':' || cast(user_id % 60 as string) || '.5' WHEN 4 THEN ' ' || cast(event_id % 60 as string) || ':07 '
  WHEN 5 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN '1:2:3:4' WHEN 8 THEN '-' || cast(1 + event_id % 60 as string) WHEN 9 THEN cast(event_id % 60 as string) || ':' WHEN 10 THEN '3:x' ELSE cast(event_id % 60 as string) || ':5.1239' END"""


def ms_parse_clip(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.expr(_TEXTS).alias("t"))
    return e.select("event_id", "t", D.clock_to_ms(F.col("t")).alias("ms"))


def ms_parse_frames(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", F.expr(_TEXTS).alias("t"))
    return e.select("event_id", "t", D.frame_clock_to_ms(F.col("t")).alias("ms"))


def fps_values(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", (F.floor("value").cast("double") / 64 + 0.25).alias("step"))
    return e.select("event_id", D.fps_text(F.col("step")).alias("fps"))


def range_problems(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("a"), (F.col("event_id") * 7 % 600).alias("b"))
    return e.select("event_id", D.range_problem(F.col("a"), F.col("b"), F.lit(550)).alias("problem"))


QUERIES = {
    f.__name__: f
    for f in (
        compare_model_stats, compare_class_dist, compare_highlights, compare_class_sets, frame_window_stride, frame_estimate, bench_stats, bench_speedup_capacity,
        epoch_best, epoch_monotone, epoch_metrics, track_chain_scores, drift_sample, ms_format, ffmpeg_time, ms_parse_clip, ms_parse_frames, fps_values, range_problems,
    )
}

_STATS = f"""WITH {V.DETECTIONS}, fr AS (
  SELECT model, video_id, frame_no, count(*) FILTER (found) AS n, sum(conf) FILTER (found) AS conf, max(infer_ms) AS ms FROM detections GROUP BY ALL),
st AS (SELECT model, count(*) AS frames, sum(n)::BIGINT AS detections, sum(n) / count(*) AS per_frame, 1 - count(*) FILTER (n > 0) / count(*) AS empty_share,
  sum(conf) / sum(n) AS mean_conf, sum(ms) / count(*) AS mean_ms, 1000 / (sum(ms) / count(*)) AS fps, count(*) FILTER (ms IS NULL) AS errors FROM fr GROUP BY model)"""
_BENCH = """WITH b AS (SELECT event_type AS model, count(*) AS n, avg(value * 0.125) AS pre, avg(value * 0.75) AS infer, avg(value * 0.125) AS post, avg(value) AS total, median(value) AS median,
  list_sort(list(value))[floor(0.95 * (count(*) - 1))::BIGINT + 1] AS p95, 1000 / avg(value) AS fps FROM events GROUP BY event_type)"""
_EPOCHS = """WITH ep AS (SELECT 'r' || (user_id % 3) AS run, date_diff('day', DATE '2023-12-31', ts::DATE)::INT AS epoch, avg(value) AS loss, avg((event_type = 'purchase')::INT) AS map FROM events GROUP BY ALL)"""

ORACLE = {
    "compare_model_stats": f"{_STATS} SELECT model, frames, detections, round(per_frame, 6) AS per_frame, round(empty_share, 6) AS empty_share, round(mean_conf, 6) AS mean_conf, round(mean_ms, 6) AS mean_ms, round(fps, 6) AS fps, errors FROM st",
    "compare_class_dist": f"WITH {V.DETECTIONS} SELECT model, cls, count(*) AS n FROM detections WHERE found GROUP BY ALL",
    "compare_highlights": f"""{_STATS} SELECT * FROM (SELECT 'detections' AS what, model, round(detections::DOUBLE, 6) AS value FROM st ORDER BY value DESC, model LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'fps', model, round(fps, 6) AS v FROM st ORDER BY v DESC, model LIMIT 1) UNION ALL SELECT * FROM (SELECT 'mean_conf', model, round(mean_conf, 6) AS v FROM st ORDER BY v DESC, model LIMIT 1)""",
    "compare_class_sets": """WITH c AS (SELECT DISTINCT 'm' || (p_partkey % 3) AS model, p_type || ' ' || (p_size % 4) AS name FROM part WHERE p_partkey % 37 < 9),
c2 AS (SELECT * FROM c WHERE NOT (model = 'm1' AND name LIKE 'E%') AND NOT (model = 'm2' AND name LIKE '%3')),
common AS (SELECT name FROM c2 GROUP BY name HAVING count(*) = (SELECT count(DISTINCT model) FROM c2))
SELECT model, count(*)::INT AS n, coalesce(string_agg(name, ',' ORDER BY name) FILTER (name NOT IN (SELECT name FROM common)), '') AS only_here, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM common), '') AS common,
  (SELECT count(DISTINCT s) FROM (SELECT list_sort(list(name)) AS s FROM c2 GROUP BY model)) = 1 AS same FROM c2 GROUP BY model""",
    "frame_window_stride": f"""WITH {V.DETECTIONS}, f AS (SELECT video_id, frame_no, ([25.0, 30.0, 12.5, 24.0, 29.97]::DOUBLE[])[video_id::INT + 1] AS fps, max(frame_no) OVER (PARTITION BY video_id) + 1 AS total FROM detections),
w AS (SELECT *, trunc(2.0::DOUBLE * fps)::BIGINT AS s, least(total, trunc(90.0::DOUBLE * fps)::BIGINT) AS e, greatest(1, round_even(fps / 5, 0)::BIGINT) AS stride FROM f),
v AS (SELECT *, CASE WHEN e > s THEN s ELSE 0 END AS a, CASE WHEN e > s THEN e ELSE total END AS b FROM w)
SELECT video_id, frame_no, stride, round(greatest(1.0, fps / stride), 6) AS out_fps FROM v WHERE frame_no >= a AND frame_no < b AND (frame_no - a) % stride = 0""",
    "frame_estimate": """WITH e AS (SELECT event_id, user_id % 9 AS sf, CASE WHEN event_id % 4 < 3 THEN event_id % 7 * 1000 END AS s, CASE WHEN event_id % 4 < 2 THEN event_id % 7 * 1000 + 500 + event_id % 11 * 300 WHEN event_id % 4 = 2 THEN event_id % 7 * 1000 - 100 END AS t FROM events),
f AS (SELECT *, greatest(0, trunc(s / 1000 * 25)::BIGINT) AS a, least(400, trunc(t / 1000 * 25)::BIGINT) AS b, CASE WHEN sf > 0 THEN greatest(1, round_even(25.0::DOUBLE / sf, 0)::BIGINT) ELSE 1 END AS stride FROM e),
g AS (SELECT event_id, stride, CASE WHEN s IS NOT NULL AND t IS NOT NULL AND b > a THEN a ELSE 0 END AS first_frame, CASE WHEN s IS NOT NULL AND t IS NOT NULL AND b > a THEN b ELSE 400 END AS end_frame FROM f)
SELECT event_id, first_frame, end_frame, stride, CASE WHEN end_frame <= first_frame THEN 0 ELSE greatest(1, (end_frame - first_frame + stride - 1) // stride) END AS estimate FROM g""",
    "bench_stats": f"{_BENCH} SELECT model, n, round(pre, 6) AS pre, round(infer, 6) AS infer, round(post, 6) AS post, round(total, 6) AS total, round(median, 6) AS median, round(p95, 6) AS p95, round(fps, 6) AS fps FROM b",
    "bench_speedup_capacity": f"{_BENCH} SELECT model, round((SELECT total FROM b WHERE model = 'view') / total, 6) AS speed_up, round(fps / 2, 6) AS cameras FROM b",
    "epoch_best": f"""{_EPOCHS} SELECT run, arg_min(epoch, struct_pack(a := -map, b := epoch)) AS best_epoch, round(max(map), 6) AS best_map, max(epoch) AS last_epoch, round(arg_max(loss, epoch), 6) AS last_loss, round(arg_max(map, epoch), 6) AS last_map FROM ep GROUP BY run""",
    "epoch_monotone": """WITH r AS (SELECT 'r' || (user_id % 3) AS run, event_id AS seq, (event_id // 25 + event_id * 13 % 7 - 2)::INT AS epoch, 300 AS epochs, value AS loss FROM events),
m AS (SELECT *, coalesce(max(CASE WHEN epoch <= epochs THEN epoch END) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS best FROM r)
SELECT run, seq, epoch, epochs, loss FROM m WHERE epoch <= epochs AND epoch > greatest(best, 0)""",
    "epoch_metrics": "SELECT event_id, round(value + CASE WHEN event_id % 3 <> 0 THEN 1.5 ELSE 0 END + 0.25, 6) AS loss, CASE WHEN event_id % 4 < 3 THEN round(user_id / 1000, 6) END AS map50 FROM events",
    "track_chain_scores": """WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 29 <> 0 THEN 1 - value / 2003 END AS flow, 1 - (event_id % 100) * 0.0065::DOUBLE AS likeness FROM events),
t AS (SELECT *, max((flow IS NULL OR likeness < 0.4)::INT) OVER w AS lost, row_number() OVER w AS step FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, step::INT AS step, round(greatest(0, least(1, 0.35 * flow + 0.65 * least(1, likeness / 0.8))), 6) AS confidence FROM t WHERE lost = 0""",
    "drift_sample": """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS j FROM orders)
SELECT o_orderkey, o_orderstatus FROM o WHERE (SELECT count(*) FROM orders) <= 4000 OR j IN (SELECT i * (SELECT count(*) FROM orders) // 4000 FROM range(4000) t(i))""",
    "ms_format": """WITH e AS (SELECT event_id, greatest(0, event_id * 7919 - 5000) AS ms, event_id % 61 AS f FROM events)
SELECT event_id, CASE WHEN ms // 60000 < 10 THEN '0' ELSE '' END || (ms // 60000) || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock,
  CASE WHEN f > 0 THEN round_even(1000 / f, 0)::BIGINT ELSE 40 END AS frame_ms FROM e""",
    "ffmpeg_time": """WITH e AS (SELECT event_id, greatest(0, event_id * 104729 - 5000) AS ms FROM events)
SELECT event_id, CASE WHEN ms // 3600000 < 10 THEN '0' ELSE '' END || (ms // 3600000) || ':' || lpad((ms % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((ms % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS clock FROM e""",
    "ms_parse_clip": f"""WITH e AS (SELECT event_id, {_TEXTS} AS t FROM events), p AS (SELECT *, string_split(replace(trim(t), ',', '.'), ':') AS s FROM e)
SELECT event_id, t, CASE WHEN len(s) <= 3 AND regexp_full_match(s[-1], '[0-9]+[.]?[0-9]*|[.][0-9]+') AND (len(s) < 2 OR regexp_full_match(s[-2], '[0-9]+')) AND (len(s) < 3 OR regexp_full_match(s[-3], '[0-9]+'))
  THEN round_even((try_cast(s[-1] AS DOUBLE) + CASE WHEN len(s) >= 2 THEN try_cast(s[-2] AS BIGINT) ELSE 0 END * 60 + CASE WHEN len(s) = 3 THEN try_cast(s[-3] AS BIGINT) ELSE 0 END * 3600) * 1000, 0)::BIGINT ELSE -1 END AS ms FROM p""",
    "ms_parse_frames": f"""WITH e AS (SELECT event_id, {_TEXTS} AS t FROM events),
p AS (SELECT *, CASE WHEN contains(t, ':') THEN split_part(trim(t), ':', 1) ELSE '0' END AS m, CASE WHEN contains(t, ':') THEN substr(trim(t), strpos(trim(t), ':') + 1) ELSE trim(t) END AS r FROM e),
q AS (SELECT *, split_part(r, '.', 1) AS s, CASE WHEN contains(r, '.') THEN rpad(substr(substr(r, strpos(r, '.') + 1), 1, 3), 3, '0') ELSE '000' END AS f FROM p)
SELECT event_id, t, CASE WHEN regexp_full_match(m, '[+-]?[0-9]+') AND regexp_full_match(s, '[+-]?[0-9]+') AND regexp_full_match(f, '[0-9]+') THEN (try_cast(m AS BIGINT) * 60 + try_cast(s AS BIGINT)) * 1000 + try_cast(f AS BIGINT) ELSE -1 END AS ms FROM q""",
    "fps_values": "WITH e AS (SELECT event_id, floor(value) / 64 + 0.25 AS step FROM events) SELECT event_id, CASE WHEN step >= 1 THEN '1/' || step::VARCHAR ELSE round_even(1 / step, 4)::VARCHAR END AS fps FROM e",
    "range_problems": "WITH e AS (SELECT event_id, event_id % 500 AS a, least(550, event_id * 7 % 600) AS b FROM events) SELECT event_id, CASE WHEN b <= a THEN 'end before start' WHEN b - a < 50 THEN 'too short' END AS problem FROM e",
}
