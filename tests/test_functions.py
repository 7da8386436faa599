"""Durations, names, geometry, model comparison, chains and edits on single values."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.functions import geometry as G
from tagmill.functions import text as X
from tagmill.functions import timefmt as D
from tagmill.operators import autolabel, compare, edits, tracking


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(("text", "ms"), [("1:02.5", 62500), ("0,25", 250), ("1:00:00", 3600000), ("", -1), ("a", -1), ("1:2:3:4", -1), ("-5", -1), (" 7 ", 7000), ("0.0005", 0), ("0.0015", 2)])
def test_clip_clock(spark, text, ms):
    assert one(spark, D.clock_to_ms(F.lit(text))) == (ms,)


@pytest.mark.parametrize(("text", "ms"), [("1:02.5", 62500), ("5", 5000), ("1:2.12345", 62123), ("1:2:3", -1), ("0,25", -1), ("x", -1), (":5", -1)])
def test_frame_clock(spark, text, ms):
    assert one(spark, D.frame_clock_to_ms(F.lit(text))) == (ms,)


def test_clocks(spark):
    assert one(spark, D.ms_to_clock(F.lit(6_123_004)), D.ms_to_clock(F.lit(-5)), D.ms_to_ffmpeg(F.lit(3_723_004))) == ("102:03.004", "00:00.000", "01:02:03.004")
    assert one(spark, D.fps_text(F.lit(2.0)), D.fps_text(F.lit(0.3)), D.frame_ms(F.lit(25.0)), D.frame_ms(F.lit(0.0))) == ("1/2.0", "3.3333", 40, 40)


def test_names(spark):
    assert one(spark, X.safe_name(F.lit(" a/b  ç ")), X.safe_name(F.lit("  ")), X.human_size(F.lit(1280)), X.human_size(F.lit(5)), X.human_size(F.lit(3 << 30))) == ("a_b_ç", "model", "1.2 KB", "5 B", "3.0 GB")
    assert one(spark, X.out_stem(F.lit("/d/k/f.jpg"), F.lit("/d")), X.out_stem(F.lit("/d/f.jpg"), F.lit("/d")), X.out_stem(F.lit("/e/k/f.jpg"), F.lit("/d"))) == ("k_f", "f", "f")
    assert one(spark, *X.hex_to_bgr(F.lit("#0a0B0c")).values()) == (12, 11, 10)
    assert one(spark, X.clip_name(F.lit("p_"), F.lit(7), F.lit(".mp4")), X.clip_index(F.lit("p_clip_0123.mp4")), X.clip_index(F.lit("x"))) == ("p_clip_007.mp4", 123, None)


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    assert one(spark, G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)), G.iou(box(0, 0, 1, 1), box(1, 0, 2, 1)), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == (pytest.approx(1 / 7), 0.0, 0.0)
    assert one(spark, G.uncertainty(F.lit(0.5)), G.error_score(F.lit(1), F.lit(2), F.lit(2)), G.area_bucket(F.lit(0.005)), G.area_bucket(F.lit(0.05))) == (1.0, 6.0, "medium", "large")


def test_monotone_epochs(spark):
    rows = [("a", i, e, 5, 0.1 * i) for i, e in enumerate((1, 2, 2, 4, 3, 6, 5, 5))] + [("b", 0, 0, 5, 1.0)]
    df = spark.createDataFrame(rows, "run string, seq int, epoch int, epochs int, loss double")
    assert [(r.seq, r.epoch) for r in compare.monotone_epochs(df).orderBy("seq").collect()] == [(0, 1), (1, 2), (3, 4), (6, 5)]


def test_model_stats_without_frames_found(spark):
    df = spark.createDataFrame([("m", "v", 1, False, None, None), ("m", "v", 2, True, 0.5, 10.0), ("m", "v", 2, True, 0.7, 10.0)], "model string, video_id string, frame_no int, found boolean, conf double, infer_ms double")
    r = compare.model_stats(df).first()
    assert (r.frames, r.detections, r.per_frame, r.empty_share, r.errors) == (2, 2, 1.0, 0.5, 1) and r.mean_conf == pytest.approx(0.6)


def test_class_selection():
    assert autolabel.normal_selection([0, 1, 2], [0, 1, 2]) == (None, [])
    assert autolabel.normal_selection([1, 9], [0, 1]) == ([1], [9])


def test_predictor(spark):
    import pandas as pd

    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    fake = lambda pdf: pd.DataFrame([(i, 0, 1, 0.5, 0.0, 0.0, 1.0, 1.0) for i in pdf["image_id"]], columns=["image_id", "pr", "cls", "conf", "x1", "y1", "x2", "y2"])
    assert {r.image_id for r in autolabel.predict(images, fake).collect()} == {"a", "b"}


def test_take_while(spark):
    df = spark.createDataFrame([("a", i, i == 3) for i in range(6)] + [("b", i, False) for i in range(4)], "k string, f int, stop boolean")
    assert sorted((r.k, r.f) for r in tracking.take_while(df, ["k"], "f", "stop", 2).collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert tracking.take_while(df, ["k"], "f", "stop").count() == 7


def test_track_stops_when_lost_and_keeps_hand_labels(spark):
    def step(last, now, box):
        return (tuple(c + 1 for c in box), 0.9) if now != "gone" else (None, 0.0)

    rows = [("c", 0, "x", [0.0, 0.0, 5.0, 5.0]), ("c", 1, "x", None), ("c", 2, "x", None), ("c", 3, "gone", None), ("c", 4, "x", None), ("c", 5, "x", [9.0, 9.0, 12.0, 12.0]), ("c", 6, "x", None)]
    df = spark.createDataFrame(rows, "clip_id string, frame_no long, content string, box array<double>")
    assert [(r.frame_no, r.x1) for r in tracking.track(df, step).orderBy("frame_no").collect()] == [(1, 1.0), (2, 2.0), (6, 10.0)]


def test_likeness():
    a = np.arange(16.0).reshape(4, 4)
    assert tracking.likeness(a, a * 2 + 3) == pytest.approx(1) and tracking.likeness(a, np.ones((4, 4))) == 0 and tracking.likeness(a, a[:2]) == 0


def test_edits(spark):
    boxes = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 5.0, 5.0), ("a", 1, 1, 0.0, 0.0, 5.0, 5.0), ("a", 2, 1, 0.0, 0.0, 5.0, 5.0)], "image_id string, gi int, cls int, x1 double, y1 double, x2 double, y2 double")
    log = spark.createDataFrame(
        [("a", 0, 1, "delete", 1, 0.0, 0.0, 5.0, 5.0), ("a", 1, 2, "class", 9, 0.0, 0.0, 0.0, 0.0), ("a", 1, 3, "move", 1, 1.0, 1.0, 6.0, 6.0), ("a", 7, 4, "add", 0, 2.0, 2.0, 3.0, 3.0), ("a", 7, 5, "class", 2, 0.0, 0.0, 0.0, 0.0)],
        "image_id string, gi int, seq int, op string, cls int, x1 double, y1 double, x2 double, y2 double",
    )
    rows = {r.gi: (r.cls, r.x1) for r in edits.apply_log(boxes, log, 3).collect()}
    assert rows == {1: (2, 1.0), 2: (1, 0.0), 7: (2, 2.0)}


def test_human_sizes_of_ids_whose_cube_leaves_a_long(spark, tmp_path):
    from tagmill.plans import scalars

    ids = [0, 7, 15_874, 2_097_151, 2_097_152, 6_000_000, 2**62 + 1]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.n for r in scalars.human_sizes(spark, str(tmp_path)).collect()} == {i: i**3 % 4_000_000_000_000 for i in ids}
