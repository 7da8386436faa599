"""What the sinks write, as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import split as P
from ..session import cut
from ..sinks import labels as K
from . import duplicates, evaluation, labelling
from . import views as V


def yolo_lines(spark, sf_dir):
    """Every image's label text, with the digits of C's printf."""
    boxes = evaluation._normal(spark, sf_dir).withColumnRenamed("gi", "box_no")
    return K.label_texts(V.images(spark, sf_dir), boxes)


def split_manifest(spark, sf_dir):
    assigned = duplicates._image_split(spark, sf_dir).join(V.images(spark, sf_dir).select("image_id", "path"), "image_id")
    return K.split_manifest(assigned, "/out")


def quarantine_manifest(spark, sf_dir):
    audited = labelling._audited(spark, sf_dir)
    return K.quarantine_manifest(audited, "dup").unionByName(K.quarantine_manifest(audited, "err"))


def top_n_manifest(spark, sf_dir):
    scores = M.matched_image_scores(V.gt(spark, sf_dir), V.pred(spark, sf_dir))
    return K.top_n_manifest(scores, "score", 50)


def frame_manifest(spark, sf_dir):
    videos = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("video_id"), (F.col("event_id") % 5000).alias("start_ms"), (F.col("event_id") % 5000 + F.floor(F.col("value") * 20)).alias("end_ms"))
    return K.frame_manifest(videos, 1000)


def clip_manifest(spark, sf_dir):
    clips = V.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("index"), (F.col("turn") * 900).alias("start_ms"), (F.col("turn") * 900 + (F.col("conv_id") * 37 + F.col("turn")) % 1000).alias("end_ms"), F.lit(3200).cast("long").alias("duration_ms"))
    return K.clip_manifest(clips, F.lit("v_"), F.lit(".mp4")).select("conv_id", "index", "end_ms", "name", "problem")


def split_materials(spark, sf_dir):
    """Images that may be split, in groups by customer, with their part."""
    images = labelling.split_eligible(spark, sf_dir)
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("key"))
    rows = cut(images.join(o, "image_id").select("image_id", "key"))  # else the audit runs for the groups and again for their images
    return rows.join(P.assign_splits(rows.select("key"), (0.6, 0.3, 0.1)), "key").select("image_id", "key", "split")


QUERIES = {f.__name__: f for f in (yolo_lines, split_manifest, quarantine_manifest, top_n_manifest, frame_manifest, clip_manifest, split_materials)}

_ELIGIBLE = labelling.ORACLE["split_eligible"]
ORACLE = {
    "yolo_lines": f"""{evaluation._NORMAL}, {V.IMAGES}, l AS (SELECT image_id, string_agg(printf('%d %.6f %.6f %.6f %.6f', cls, cx, cy, w, h), chr(10) ORDER BY gi) || chr(10) AS text FROM n GROUP BY image_id)
SELECT image_id, coalesce(text, '') AS text FROM images LEFT JOIN l USING (image_id)""",
    "split_manifest": f"{duplicates._IMAGES}, {V.IMAGES} SELECT path, split, '/out/' || split || '/images/' || stem || '.jpg' AS target FROM sp JOIN images USING (image_id)",
    "quarantine_manifest": f"{labelling._AUDIT} SELECT image_id, 'dup' AS reason FROM aud WHERE dup_group IS NOT NULL AND NOT dup_rep UNION ALL SELECT image_id, 'err' FROM aud WHERE n_errors > 0",
    "top_n_manifest": f"{evaluation._MATCH} {evaluation._SCORES} SELECT row_number() OVER (ORDER BY score DESC, image_id)::INT AS place, image_id, score FROM sc ORDER BY score DESC, image_id LIMIT 50",
    "frame_manifest": """WITH v AS (SELECT event_id AS video_id, event_id % 5000 AS a, event_id % 5000 + floor(value * 20)::BIGINT AS b FROM events),
f AS (SELECT video_id, a, unnest(range(0, b - a, 1000)) AS d FROM v WHERE b > a) SELECT video_id, (d // 1000 + 1)::INT AS number, a + d AS ts_ms, printf('kare_%05d.jpg', d // 1000 + 1) AS name FROM f""",
    "clip_manifest": f"""WITH c AS (SELECT conv_id, turn, turn * 900 AS a, least(3200, turn * 900 + (conv_id * 37 + turn) % 1000) AS b FROM conversations)
SELECT conv_id, turn AS index, b AS end_ms, 'v_clip_' || CASE WHEN length(turn::VARCHAR) < 3 THEN lpad(turn::VARCHAR, 3, '0') ELSE turn::VARCHAR END || '.mp4' AS name,
  CASE WHEN b <= a THEN 'end before start' WHEN b - a < 50 THEN 'too short' END AS problem FROM c""",
    "split_materials": f"""WITH RECURSIVE el AS ({_ELIGIBLE}), keys AS (SELECT image_id, 'm' || o_custkey AS key FROM el JOIN orders ON o_orderkey = image_id), {duplicates._fold_sql((0.6, 0.3, 0.1))}
SELECT image_id, key, split FROM keys JOIN fill USING (key)""",
}
