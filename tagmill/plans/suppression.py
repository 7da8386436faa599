"""Queries of non-maximum suppression, over two detectors' boxes of each image and over crowded images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.suppress import non_maximum
from . import views

#: A second detector sees each true box two pixels to the right, with a confidence of its own.
_SECOND = "image_id, cls, cast((31 * cast(x1 as bigint) + 7 * cast(y1 as bigint) + gi) % 1000 as double) / 1000 AS conf, x1 + 2 AS x1, y1 AS y1, x2 + 2 AS x2, y2 AS y2"
_ORDER = "conf DESC, cls, x1, y1, x2, y2"
#: Orders in a crowded image.
CROWD = 16
_COLUMNS = ["image_id", "pr", "cls", "conf", "x1", "y1", "x2", "y2", "place"]


def _numbered(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("image_id").orderBy(F.desc("conf"), "cls", "x1", "y1", "x2", "y2")
    return rows.withColumn("pr", F.row_number().over(order) - 1)


def both(spark: SparkSession, sf_dir: str, crowd: int = 1) -> DataFrame:
    """image_id, pr, cls, conf and corners of two detectors' boxes; ``crowd`` orders that follow each other are one image."""
    # Both boxes of a line item come from one row, which lies where its image is numbered: one shuffle in all.
    first = F.struct(*[F.expr(x) for x in views._exprs({k: x for k, x in views._PRED.items() if k not in ("image_id", "gi")})])
    rows = views.box_rows(spark, sf_dir, f"floor(l_orderkey / {crowd})").select("dealt", first.alias("first"), F.expr(views.PREDICTED).alias("seen"), *[F.expr(x) for x in views._exprs(views._BOX)])
    rows = rows.selectExpr("dealt", "first", "seen", *views._exprs(views._GT))
    second = F.struct(*[F.expr(x.strip()) for x in _split(_SECOND)[1:]])
    return _numbered(rows.select(F.col("dealt").alias("image_id"), F.inline(F.when(F.col("seen"), F.array("first", second)).otherwise(F.array(second)))))


def _split(columns: str) -> list[str]:
    """Columns at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _sql(crowd: int, threshold: float, least: float, most: int, agnostic: bool) -> str:
    return f"""
WITH RECURSIVE {views.BOTH},
two AS (SELECT image_id, cls, conf, x1, y1, x2, y2 FROM pred UNION ALL SELECT {_SECOND} FROM gt),
d AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) - 1 AS pr, row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) AS k
  FROM (SELECT floor(image_id / {crowd})::BIGINT AS image_id, * EXCLUDE image_id FROM two)),
f AS (SELECT * FROM d WHERE conf >= {least}),
nms AS (
  SELECT image_id, 0::BIGINT AS k, []::STRUCT(pr BIGINT, cls INT, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM (SELECT DISTINCT image_id FROM f)
  UNION ALL
  SELECT n.image_id, n.k + 1, CASE WHEN len(list_filter(n.kept, lambda b: {"TRUE" if agnostic else "b.cls = f.cls"} AND {views.iou_sql("b", "f")} > {threshold})) > 0 THEN n.kept
    ELSE list_append(n.kept, {{'pr': f.pr, 'cls': f.cls, 'conf': f.conf, 'x1': f.x1, 'y1': f.y1, 'x2': f.x2, 'y2': f.y2}}) END
  FROM nms n JOIN f ON f.image_id = n.image_id AND f.k = n.k + 1),
last AS (SELECT image_id, arg_max(kept, k) AS kept FROM nms GROUP BY image_id),
flat AS (SELECT image_id, unnest(kept) AS b, unnest(range(1, len(kept) + 1))::INT AS place FROM last)
SELECT image_id, b.pr::INT AS pr, b.cls AS cls, b.conf AS conf, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2, place FROM flat WHERE place <= {most}"""


_KINDS = {
    "nms_by_class": {"crowd": 1, "threshold": 0.45, "least": 0.25, "most": 300, "agnostic": False},
    "nms_agnostic": {"crowd": 1, "threshold": 0.45, "least": 0.001, "most": 5, "agnostic": True},
    "nms_crowded": {"crowd": CROWD, "threshold": 0.3, "least": 0.05, "most": 40, "agnostic": True},
}


def _query(crowd: int, threshold: float, least: float, most: int, agnostic: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return non_maximum(both(spark, sf_dir, crowd), threshold=threshold, least_conf=least, most=most, agnostic=agnostic).select(*_COLUMNS)

    return run


QUERIES = {name: _query(**kind) for name, kind in _KINDS.items()}
ORACLE = {name: _sql(**kind) for name, kind in _KINDS.items()}
