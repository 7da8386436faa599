"""Queries of points against boxes: which box, which corner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.hits import HANDLE, box_hits, handle_hits
from . import views

#: A point of each line item, in the image that three orders share.
_POINT = "l_orderkey * 1000 + gi AS point, floor(l_orderkey / 3) AS image_id, cast((l_partkey * 41 + l_suppkey * 7) % 640 as double) AS x, cast((l_suppkey * 59 + l_partkey * 3) % 480 as double) AS y"
_NUMBER = "(image_id % 3) * 1000 + gi"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.box_rows(spark, sf_dir).selectExpr(*_POINT.split(", "))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.gt(spark, sf_dir).selectExpr("floor(image_id / 3) AS image_id", f"{_NUMBER} AS gi", "x1", "y1", "x2", "y2")


def point_box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_hits(_points(spark, sf_dir), _boxes(spark, sf_dir))


def point_handle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handle_hits(_points(spark, sf_dir), _boxes(spark, sf_dir))


_WITH = f"""WITH {views.GT},
p AS (SELECT {_POINT.replace("floor(l_orderkey / 3)", "l_orderkey // 3")} FROM r),
b AS (SELECT image_id // 3 AS image_id, {_NUMBER} AS gi, x1, y1, x2, y2 FROM gt)"""
QUERIES = {f.__name__: f for f in (point_box_hits, point_handle_hits)}
ORACLE = {
    "point_box_hits": f"""{_WITH}
SELECT p.point, min(b.gi)::BIGINT AS hit FROM p LEFT JOIN b ON b.image_id = p.image_id AND p.x BETWEEN b.x1 AND b.x2 AND p.y BETWEEN b.y1 AND b.y2 GROUP BY p.point""",
    "point_handle_hits": f"""{_WITH},
c AS (SELECT image_id, gi, unnest([0, 1, 2, 3]) AS handle, unnest([x1, x2, x1, x2]) AS cx, unnest([y1, y1, y2, y2]) AS cy FROM b),
n AS (SELECT p.point, min({{'away': abs(p.x - c.cx) + abs(p.y - c.cy), 'hit': c.gi, 'handle': c.handle}}) AS m
  FROM p JOIN c ON c.image_id = p.image_id AND abs(p.x - c.cx) + abs(p.y - c.cy) <= {HANDLE} GROUP BY p.point)
SELECT p.point, n.m.hit::BIGINT AS hit, n.m.handle AS handle, n.m.away AS away FROM p LEFT JOIN n USING (point)""",
}
