"""Evaluation of predictions, active learning and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import matching as M
from ..operators import ranking as R
from ..operators.autolabel import autolabel_summary
from . import views as V


def _matched(spark, sf_dir):
    return M.match(V.gt(spark, sf_dir), V.pred(spark, sf_dir))


def box_iou_pairs(spark, sf_dir):
    pairs = M.overlaps(V.pred(spark, sf_dir), V.gt(spark, sf_dir), 1e-9)
    return pairs.select("image_id", F.col("a_pr").alias("pr"), F.col("b_gi").alias("gi"), F.round("iou", 6).alias("iou"))


def eval_match_rows(spark, sf_dir):
    return _matched(spark, sf_dir).withColumn("iou", F.round("iou", 6))


def eval_totals(spark, sf_dir):
    return _rounded(M.totals(_matched(spark, sf_dir)), "precision", "recall", "f1")


def _rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


def eval_confusion(spark, sf_dir):
    return M.confusion(_matched(spark, sf_dir), V.CLASSES)


def eval_confusion_pivot(spark, sf_dir):
    return M.confusion_matrix(_matched(spark, sf_dir), V.CLASSES)


def eval_class_prf(spark, sf_dir):
    return _rounded(M.class_scores(_matched(spark, sf_dir)), "precision", "recall", "f1")


def _image_scores(spark, sf_dir):
    return M.matched_image_scores(V.gt(spark, sf_dir), V.pred(spark, sf_dir))


def eval_image_scores(spark, sf_dir):
    return _image_scores(spark, sf_dir)


def eval_worst_images(spark, sf_dir):
    return M.worst_images(_matched(spark, sf_dir), 15)


def eval_filter_views(spark, sf_dir):
    return M.eval_view_counts(_image_scores(spark, sf_dir))


def eval_marks(spark, sf_dir):
    """The marks an image viewer draws: kind, normalised box and text."""
    shown = M.match(V.gt(spark, sf_dir), V.pred(spark, sf_dir), keep=M.CORNERS).where("image_id IS NOT NULL")
    at = {c: F.when(F.col("kind") == "fn", F.col(f"gt_{c}")).otherwise(F.col(f"pred_{c}")) for c in M.CORNERS}
    text = F.concat_ws(">", F.col("gt_cls").cast("string"), F.col("pred_cls").cast("string"))
    scaled = [F.round(x / (V.WIDTH if c[0] == "x" else V.HEIGHT), 8).alias(c) for c, x in at.items()]
    return shown.select("image_id", "kind", text.alias("label"), *scaled)


def _active(spark, sf_dir):
    return R.active_scores(V.images(spark, sf_dir), V.pred(spark, sf_dir))


def active_scores(spark, sf_dir):
    return _rounded(_active(spark, sf_dir), "score", "max_conf")


def active_rank(spark, sf_dir):
    return _rounded(R.active_rank(_active(spark, sf_dir), 50), "score", "max_conf")


def active_summary(spark, sf_dir):
    return R.active_summary(_active(spark, sf_dir))


def _candidate(spark, sf_dir):
    """A second model: the first's boxes without some, shifted a little, with other confidences."""
    p = V.pred(spark, sf_dir).where("pr % 9 <> 8")
    return p.selectExpr("image_id", "pr", "cls", "abs(conf - 0.03D) AS conf", "x1 + pr % 4 AS x1", "y1 AS y1", "x2 + pr % 4 AS x2", "y2 AS y2")


def drift_match(spark, sf_dir):
    return _rounded(M.drift(V.pred(spark, sf_dir), _candidate(spark, sf_dir)), "iou", "d_conf")


def drift_verdict(spark, sf_dir):
    ref, cand = V.pred(spark, sf_dir), _candidate(spark, sf_dir)
    return _rounded(M.drift_summary(ref, cand, M.drift(ref, cand)), "ratio", "mean_iou", "mean_d_conf")


def autolabel_counts(spark, sf_dir):
    return autolabel_summary(V.images(spark, sf_dir), V.pred(spark, sf_dir), classes=[0, 1, 2, 3], least_conf=0.25)


def box_xywhn_to_xyxy(spark, sf_dir):
    b = _normal(spark, sf_dir)
    corners = G.xywhn_to_xyxy(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(V.WIDTH), F.lit(V.HEIGHT))
    return b.select("image_id", "gi", *[F.round(x, 6).alias(k) for k, x in corners.items()])


def _normal(spark, sf_dir):
    b = V.gt(spark, sf_dir)
    centre = G.to_centre(*[F.col(c) for c in M.CORNERS], F.lit(V.WIDTH), F.lit(V.HEIGHT))
    return b.select("image_id", "gi", "cls", *[x.alias(k) for k, x in centre.items()])


def box_to_yolo(spark, sf_dir):
    return _rounded(_normal(spark, sf_dir), "cx", "cy", "w", "h", digits=8)


def box_to_yolo_clip(spark, sf_dir):
    b = V.raw_boxes(spark, sf_dir)
    cut = G.clip_to_centre(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(float(V.WIDTH)), F.lit(float(V.HEIGHT)))
    return b.select("image_id", "gi", *[(F.round(x, 8) if k in ("cx", "cy", "w", "h") else x).alias(k) for k, x in cut.items()])


def box_from_yolo_int(spark, sf_dir):
    b = _normal(spark, sf_dir).select("image_id", "gi", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "w", "h")])
    pixels = G.to_pixels(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(V.WIDTH), F.lit(V.HEIGHT))
    return b.select("image_id", "gi", *[x.alias(k) for k, x in pixels.items()])


def box_corner_to_size(spark, sf_dir):
    b = V.gt(spark, sf_dir)
    return b.select("image_id", "gi", *[x.alias(k) for k, x in G.corners_to_size(*[F.col(c) for c in M.CORNERS]).items()])


def box_edge_overflow(spark, sf_dir):
    b = _normal(spark, sf_dir)
    return b.where(G.overflows(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))).select("image_id", "gi", "cls")


def box_move_clamped(spark, sf_dir):
    b = V.gt(spark, sf_dir).where("x2 <= 640 AND y2 <= 480").withColumn("box", F.struct(*M.CORNERS))
    new = G.moved(F.col("box"), F.lit(75.0), F.lit(-60.0), F.lit(float(V.WIDTH)), F.lit(float(V.HEIGHT)))
    hit = G.contains(F.lit(320.0), F.lit(240.0), F.col("box"))
    return b.select("image_id", "gi", hit.alias("hit"), *[x.alias(k) for k, x in new.items()])


QUERIES = {
    f.__name__: f
    for f in (
        eval_class_prf, box_iou_pairs, eval_match_rows, eval_totals, eval_confusion, eval_confusion_pivot, eval_image_scores, eval_worst_images,
        eval_filter_views, eval_marks, active_scores, active_rank, active_summary, drift_match, drift_verdict, autolabel_counts, box_xywhn_to_xyxy,
        box_to_yolo, box_to_yolo_clip, box_from_yolo_int, box_corner_to_size, box_edge_overflow, box_move_clamped,
    )
}

#: The greedy assignment as a recursion over each image's candidates.
_FOLD = """
fold AS (
  SELECT image_id, 0::BIGINT AS k, []::INT[] AS i, []::INT[] AS j, false AS ok, -1 AS pi, -1 AS pj, 0.0::DOUBLE AS iou FROM (SELECT DISTINCT image_id FROM cand)
  UNION ALL
  SELECT f.image_id, c.k,
         CASE WHEN list_contains(f.i, c.i) OR list_contains(f.j, c.j) THEN f.i ELSE list_append(f.i, c.i) END,
         CASE WHEN list_contains(f.i, c.i) OR list_contains(f.j, c.j) THEN f.j ELSE list_append(f.j, c.j) END,
         NOT (list_contains(f.i, c.i) OR list_contains(f.j, c.j)), c.i, c.j, c.iou
  FROM fold f JOIN cand c ON c.image_id = f.image_id AND c.k = f.k + 1)"""
_MATCH = f"""WITH RECURSIVE {V.BOTH}, pairs AS (
  SELECT p.image_id, p.pr AS i, g.gi AS j, {V.iou_sql("p", "g")} AS iou FROM pred p JOIN gt g ON p.image_id = g.image_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, iou DESC, j) AS k FROM pairs WHERE iou >= 0.5), {_FOLD},
m AS (
  SELECT coalesce(p.image_id, g.image_id) AS image_id,
         CASE WHEN p.pr IS NULL THEN 'fn' WHEN g.gi IS NULL THEN 'fp' WHEN p.cls = g.cls THEN 'tp' ELSE 'conf' END AS kind,
         p.pr, g.gi, p.cls AS pred_cls, g.cls AS gt_cls, p.conf, p.iou
  FROM (SELECT p.*, f.pj, f.iou FROM pred p LEFT JOIN fold f ON f.ok AND f.image_id = p.image_id AND f.pi = p.pr) p
  FULL JOIN gt g ON g.image_id = p.image_id AND g.gi = p.pj)"""
_PRF = """round(CASE WHEN tp + fp + {p} > 0 THEN tp / (tp + fp + {p}) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn + {g} > 0 THEN tp / (tp + fn + {g}) ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp + {p})) * (tp / (tp + fn + {g})) / (tp / (tp + fp + {p}) + tp / (tp + fn + {g})) ELSE 0 END, 6) AS f1"""
_SCORES = """, s AS (
  SELECT image_id, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'conf') AS conf
  FROM m GROUP BY image_id), sc AS (SELECT *, (fn + fp + 1.5 * conf)::DOUBLE AS score FROM s)"""
_CANDIDATE = "SELECT image_id, pr, cls, abs(conf - 0.03::DOUBLE) AS conf, x1 + pr % 4 AS x1, y1, x2 + pr % 4 AS x2, y2 FROM pred WHERE pr % 9 <> 8"
_DRIFT = f"""WITH RECURSIVE {V.BOTH}, c2 AS ({_CANDIDATE}), pairs AS (
  SELECT p.image_id, p.pr AS i, g.pr AS j, {V.iou_sql("p", "g")} AS iou FROM pred p JOIN c2 g ON p.image_id = g.image_id AND p.cls = g.cls),
cand AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY i, iou DESC, j) AS k FROM pairs WHERE iou >= 0.5), {_FOLD},
d AS (SELECT f.image_id, f.pi AS ref, f.pj AS cand, f.iou, abs(b.conf - a.conf) AS d_conf
  FROM fold f JOIN pred a ON a.image_id = f.image_id AND a.pr = f.pi JOIN c2 b ON b.image_id = f.image_id AND b.pr = f.pj WHERE f.ok)"""
_ACTIVE = f"""WITH {V.GT}, {V.PRED}, {V.IMAGES}, a AS (
  SELECT i.image_id, count(p.pr) AS n_box, count(*) FILTER (p.conf BETWEEN 0.25 AND 0.70) AS n_band, round(coalesce(max(p.conf), 0), 6) AS max_conf,
         round(CASE WHEN count(p.pr) = 0 THEN 1.0 ELSE coalesce(sum(1 - abs(2 * p.conf::DECIMAL(18, 6) - 1)) FILTER (p.conf BETWEEN 0.25 AND 0.70), 0) END::DOUBLE, 6) AS score
  FROM images i LEFT JOIN pred p ON p.image_id = i.image_id GROUP BY i.image_id)"""
_NORMAL = f"WITH {V.GT}, n AS (SELECT image_id, gi, cls, (x1 + x2) / 2 / 640 AS cx, (y1 + y2) / 2 / 480 AS cy, abs(x2 - x1) / 640 AS w, abs(y2 - y1) / 480 AS h FROM gt)"

ORACLE = {
    "box_iou_pairs": f"WITH {V.BOTH}, p AS (SELECT p.image_id, p.pr, g.gi, {V.iou_sql('p', 'g')} AS iou FROM pred p JOIN gt g ON p.image_id = g.image_id) SELECT image_id, pr, gi, round(iou, 6) AS iou FROM p WHERE iou >= 1e-9",
    "eval_match_rows": f"{_MATCH} SELECT * REPLACE (round(iou, 6) AS iou) FROM m",
    "eval_totals": f"{_MATCH}, t AS (SELECT count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'conf') AS conf FROM m) SELECT *, tp + conf + fn AS n_gt, tp + conf + fp AS n_pred, {_PRF.format(p='conf', g='conf')} FROM t",
    "eval_confusion": f"{_MATCH} SELECT coalesce(gt_cls, 7) AS gt_cls, coalesce(pred_cls, 7) AS pred_cls, count(*) AS n FROM m GROUP BY ALL",
    "eval_confusion_pivot": f"{_MATCH} SELECT coalesce(gt_cls, 7) AS gt_cls, " + ", ".join(f"count(*) FILTER (coalesce(pred_cls, 7) = {c}) AS p{c}" for c in range(8)) + " FROM m GROUP BY ALL",
    "eval_class_prf": f"""{_MATCH}, c AS (
  SELECT k.cls, count(*) FILTER (kind = 'tp' AND gt_cls = k.cls) AS tp, count(*) FILTER (kind = 'fp' AND pred_cls = k.cls) AS fp, count(*) FILTER (kind = 'fn' AND gt_cls = k.cls) AS fn,
         count(*) FILTER (kind = 'conf' AND gt_cls = k.cls) AS conf_gt, count(*) FILTER (kind = 'conf' AND pred_cls = k.cls) AS conf_pred
  FROM m JOIN (SELECT gt_cls AS cls FROM m WHERE gt_cls IS NOT NULL UNION SELECT pred_cls FROM m WHERE pred_cls IS NOT NULL) k ON k.cls IN (m.gt_cls, m.pred_cls) GROUP BY k.cls),
s AS (SELECT *, {_PRF.format(p="conf_pred", g="conf_gt")} FROM c) SELECT *, recall < 0.7 AS weak FROM s""",
    "eval_image_scores": f"{_MATCH} {_SCORES} SELECT * FROM sc",
    "eval_worst_images": f"{_MATCH} {_SCORES} SELECT * FROM sc WHERE score > 0 ORDER BY score DESC, image_id LIMIT 15",
    "eval_filter_views": f"{_MATCH} {_SCORES} " + " UNION ALL ".join(f"SELECT '{k}' AS view, count(*) FILTER ({x}) AS n FROM sc" for k, x in M.EVAL_VIEWS.items()),
    "eval_marks": f"""{_MATCH} SELECT m.image_id, kind, concat_ws('>', m.gt_cls::VARCHAR, m.pred_cls::VARCHAR) AS label,
  round(CASE WHEN kind = 'fn' THEN g.x1 ELSE p.x1 END / 640, 8) AS x1, round(CASE WHEN kind = 'fn' THEN g.y1 ELSE p.y1 END / 480, 8) AS y1,
  round(CASE WHEN kind = 'fn' THEN g.x2 ELSE p.x2 END / 640, 8) AS x2, round(CASE WHEN kind = 'fn' THEN g.y2 ELSE p.y2 END / 480, 8) AS y2
FROM m LEFT JOIN pred p ON p.image_id = m.image_id AND p.pr = m.pr LEFT JOIN gt g ON g.image_id = m.image_id AND g.gi = m.gi""",
    "active_scores": f"{_ACTIVE} SELECT * FROM a",
    "active_rank": f"{_ACTIVE} SELECT * FROM a ORDER BY score DESC, image_id LIMIT 50",
    "active_summary": f"{_ACTIVE} SELECT count(*) AS pool, count(*) FILTER (n_band > 0) AS uncertain, count(*) FILTER (n_box = 0) AS empty FROM a",
    "drift_match": f"{_DRIFT} SELECT image_id, ref, cand, round(iou, 6) AS iou, round(d_conf, 6) AS d_conf FROM d",
    "drift_verdict": f"""{_DRIFT}, t AS (
  SELECT (SELECT count(*) FROM pred) AS n_ref, (SELECT count(*) FROM c2) AS n_cand, count(*) AS matched, coalesce(avg(iou), 0) AS mean_iou, coalesce(avg(d_conf), 0) AS mean_d_conf FROM d)
SELECT n_ref, n_cand, matched, round(mean_iou, 6) AS mean_iou, round(mean_d_conf, 6) AS mean_d_conf, round(matched / n_ref, 6) AS ratio,
  CASE WHEN matched / n_ref < 0.95 THEN 'lost' WHEN mean_d_conf > 0.05 THEN 'confidence shift' ELSE 'ok' END AS verdict FROM t""",
    "autolabel_counts": f"""WITH {V.GT}, {V.PRED}, {V.IMAGES}, f AS (SELECT * FROM pred WHERE cls < 4 AND conf >= 0.25),
p AS (SELECT i.image_id, f.cls FROM images i LEFT JOIN f ON f.image_id = i.image_id)
SELECT 'processed' AS what, -1 AS cls, count(DISTINCT image_id) AS n FROM p UNION ALL
SELECT 'with detections', -1, count(DISTINCT image_id) FILTER (cls IS NOT NULL) FROM p UNION ALL
SELECT 'without detections', -1, count(DISTINCT image_id) - count(DISTINCT image_id) FILTER (cls IS NOT NULL) FROM p UNION ALL
SELECT 'detections', -1, count(cls) FROM p UNION ALL SELECT 'class', cls, count(*) FROM f GROUP BY cls""",
    "box_xywhn_to_xyxy": f"{_NORMAL} SELECT image_id, gi, round((cx - w / 2) * 640, 6) AS x1, round((cy - h / 2) * 480, 6) AS y1, round((cx + w / 2) * 640, 6) AS x2, round((cy + h / 2) * 480, 6) AS y2 FROM n",
    "box_to_yolo": f"{_NORMAL} SELECT image_id, gi, cls, round(cx, 8) AS cx, round(cy, 8) AS cy, round(w, 8) AS w, round(h, 8) AS h FROM n",
    "box_to_yolo_clip": f"""WITH {V.RAW}, c AS (SELECT *, greatest(0, x) AS a, greatest(0, y) AS b, least(640, x + w) AS c, least(480, y + h) AS d FROM raw)
SELECT image_id, gi, round((a + c) / 2 / 640, 8) AS cx, round((b + d) / 2 / 480, 8) AS cy, round((c - a) / 640, 8) AS w, round((d - b) / 480, 8) AS h,
  a <> x OR b <> y OR c <> x + w OR d <> y + h AS clipped, c - a <= 1e-6 OR d - b <= 1e-6 AS degenerate FROM c""",
    "box_from_yolo_int": f"""{_NORMAL}, q AS (SELECT image_id, gi, round(cx, 8) AS cx, round(cy, 8) AS cy, round(w, 8) AS w, round(h, 8) AS h FROM n)
SELECT image_id, gi, trunc((cx - w / 2) * 640)::INT AS x1, trunc((cy - h / 2) * 480)::INT AS y1, trunc((cx + w / 2) * 640)::INT AS x2, trunc((cy + h / 2) * 480)::INT AS y2 FROM q""",
    "box_corner_to_size": f"WITH {V.GT} SELECT image_id, gi, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM gt",
    "box_edge_overflow": f"{_NORMAL} SELECT image_id, gi, cls FROM n WHERE cx - w / 2 < -1e-3 OR cx + w / 2 > 1 + 1e-3 OR cy - h / 2 < -1e-3 OR cy + h / 2 > 1 + 1e-3",
    "box_move_clamped": f"""WITH {V.GT} SELECT image_id, gi, x1 + least(75, 640 - x2) AS x1, y1 + greatest(-60, -y1) AS y1, x2 + least(75, 640 - x2) AS x2, y2 + greatest(-60, -y1) AS y2,
  320 BETWEEN x1 AND x2 AND 240 BETWEEN y1 AND y2 AS hit FROM gt WHERE x2 <= 640 AND y2 <= 480""",
}
