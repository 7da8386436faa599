"""Annotation-shaped views of the star-schema tables, in Spark and as common table expressions of SQL.

An order is an image of 640 x 480 pixels, a line item a box; events are frames of a video seen by three models. All
formulas are integer arithmetic, so both engines see the same boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import table

WIDTH, HEIGHT, CLASSES = 640, 480, 7
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]


def box_rows(spark: SparkSession, sf_dir: str, dealt: str | None = None) -> DataFrame:
    """Line items with their number within the image. By ``dealt``, an expression of the image, rows stay together for what follows."""
    rows, image = table(spark, sf_dir, "lineitem"), ["l_orderkey"]
    if dealt:
        rows, image = rows.withColumn("dealt", F.expr(dealt)).repartition("dealt"), ["dealt", "l_orderkey"]
    w = W.partitionBy(*image).orderBy(*_LINE_ORDER)
    return rows.withColumn("gi", F.row_number().over(w) - 1)


_BOX = {
    "image_id": "l_orderkey",
    "gi": "cast(gi as int)",
    "cls": "cast(l_linenumber - 1 as int)",
    "x": "cast(l_partkey * 37 % 600 as double)",
    "y": "cast(l_suppkey * 53 % 440 as double)",
    "w": "cast(20 + 2 * cast(floor(l_quantity) as bigint) as double)",
    "h": "cast(20 + l_partkey % 60 as double)",
}
_GT = {"image_id": "image_id", "gi": "gi", "cls": "cls", "x1": "x", "y1": "y", "x2": "x + w", "y2": "y + h"}
_PRED = {
    "image_id": "l_orderkey",
    "gi": "cast(gi as int)",
    "cls": f"cast((l_linenumber - 1 + case when l_suppkey % 17 = 0 then 1 else 0 end) % {CLASSES} as int)",
    "conf": "cast((7 * l_partkey + 13 * l_suppkey) % 1000 as double) / 1000",
    "x1": "cast(l_partkey * 37 % 600 + l_partkey % 41 - 20 as double)",
    "y1": "cast(l_suppkey * 53 % 440 + l_suppkey % 31 - 15 as double)",
    "x2": "cast(l_partkey * 37 % 600 + l_partkey % 41 - 20 + 20 + 2 * cast(floor(l_quantity) as bigint) as double)",
    "y2": "cast(l_suppkey * 53 % 440 + l_suppkey % 31 - 15 + 20 + l_partkey % 60 as double)",
}
#: Which line items have a prediction.
PREDICTED = "(l_partkey + l_suppkey) % 10 <> 0"


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {k}" for k, x in columns.items())


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{x} AS {k}" for k, x in columns.items()]


def raw_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, gi, cls, x, y, w, h (pixels, top-left) with source, src_cls and flagged."""
    more = ["case when l_suppkey % 2 = 0 then 'A' else 'B' end AS source", "cast(l_linenumber - 1 as int) AS src_cls", "l_returnflag = 'R' AS flagged"]
    return box_rows(spark, sf_dir).selectExpr(*_exprs(_BOX), *more)


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_rows(spark, sf_dir).selectExpr(*_exprs(_BOX)).selectExpr(*_exprs(_GT))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: one for nine of ten boxes, shifted, some of another class; pr numbers them by confidence."""
    rows = box_rows(spark, sf_dir).where(PREDICTED).selectExpr(*_exprs(_PRED))
    order = W.partitionBy("image_id").orderBy(F.col("conf").desc(), "gi")
    return rows.withColumn("pr", (F.row_number().over(order) - 1).cast("int")).drop("gi")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, path and folder of every order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    stem = F.concat(F.lit("frame_"), F.col("o_orderkey").cast("string"))
    path = F.concat(F.lit("/data/"), F.col("o_orderstatus"), F.lit("/"), stem, F.lit(".jpg"))
    return o.select(F.col("o_orderkey").alias("image_id"), path.alias("path"), F.col("o_orderstatus").alias("rel_dir"), stem.alias("stem"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, video_id, frame_no, cls, conf, infer_ms of every event; events of type ``error`` count as failed calls."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "element_at(array('A', 'B', 'C'), cast(user_id % 3 as int) + 1) AS model", "cast(user_id % 5 as string) AS video_id", "event_id AS frame_no", "ts",
        "event_type AS cls", "least(value / 500, 1.0D) AS conf", "value AS infer_ms", "user_id", "event_type <> 'error' AS found",
    )


RAW = f"""
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS gi FROM lineitem),
raw AS (SELECT {_sql(_BOX)}, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, cast(l_linenumber - 1 AS INT) AS src_cls, l_returnflag = 'R' AS flagged FROM r)"""
GT = RAW + f", gt AS (SELECT {_sql(_GT)} FROM raw)"
PRED = f"""pred AS (
  SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, gi) - 1)::INT AS pr
  FROM (SELECT {_sql(_PRED)} FROM r WHERE (l_partkey + l_suppkey) % 10 <> 0))"""
BOTH = f"{GT}, {PRED}"
IMAGES = """images AS (
  SELECT o_orderkey AS image_id, '/data/' || o_orderstatus || '/frame_' || o_orderkey || '.jpg' AS path, o_orderstatus AS rel_dir, 'frame_' || o_orderkey AS stem FROM orders)"""
DETECTIONS = """detections AS (
  SELECT ['A', 'B', 'C'][(user_id % 3)::INT + 1] AS model, (user_id % 5)::VARCHAR AS video_id, event_id AS frame_no, ts, event_type AS cls,
         least(value / 500, 1.0::DOUBLE) AS conf, value AS infer_ms, user_id, event_type <> 'error' AS found FROM events)"""
IOU = """(CASE WHEN least({a}.x2, {b}.x2) <= greatest({a}.x1, {b}.x1) OR least({a}.y2, {b}.y2) <= greatest({a}.y1, {b}.y1) THEN 0.0 ELSE
  (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))
  / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1)
     - (least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * (least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) END)"""


def iou_sql(a: str, b: str) -> str:
    return IOU.format(a=a, b=b)
