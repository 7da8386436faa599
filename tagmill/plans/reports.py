"""Report rows, listing limits and rules of frames and folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timefmt as T
from ..operators import profile as P
from ..operators import tracking as K
from ..operators.numbering import numbered
from ..sources.files import hidden_folder
from . import labelling as L
from . import views as V


#: Folders that the listing of pages leaves out.
HIDDEN = ("fr", "de")


def report_errors(spark, sf_dir):
    """The first 40 damaged label lines."""
    return P.first_errors(L.label_parse_strict(spark, sf_dir), 40)


def report_orphans(spark, sf_dir):
    """The first 20 labels without an image."""
    return L.orphan_labels(spark, sf_dir).orderBy("path").limit(20)


def bench_cycle(spark, sf_dir):
    """The images of 300 timed runs, taken in turn from a listing of the first 120."""
    images = V.images(spark, sf_dir).select("image_id")
    return P.in_turn(numbered(images, "image_id").where("index < 120"), 300).select("run", "image_id")


def frame_durations(spark, sf_dir):
    return V.table(spark, sf_dir, "events").selectExpr("event_id", "(event_id % 61 - 1) / 2D AS fps").select("event_id", T.frame_ms(F.col("fps")).alias("ms"))


def hidden_folders(spark, sf_dir):
    """Whether a listing leaves out the folder of a page, whose address is one: host, path without its last step."""
    folder = F.regexp_extract(F.regexp_replace("url", "^[a-z]+://", ""), "^(.*)/[^/]*$", 1)
    return V.table(spark, sf_dir, "pages").select("page_id", folder.alias("rel_dir"), hidden_folder(folder, HIDDEN).alias("hidden"))


def track_acceptance(spark, sf_dir):
    """Steps by part: its line items are the points that were followed, there and back."""
    points = V.table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS clip", "l_linenumber < 6 AS found", "CAST(l_suppkey % 30 AS DOUBLE) / 10 AS back")
    steps = V.table(spark, sf_dir, "part").selectExpr("p_partkey AS clip", "CAST(50 + p_partkey % 100 AS DOUBLE) / 100 AS scale", "p_size AS width", "p_size + p_partkey % 3 - 1 AS height")
    return K.accepted_steps(points, steps, ["clip"]).select("clip", "n_good", "scale", "accepted")


QUERIES = {f.__name__: f for f in (report_errors, report_orphans, bench_cycle, frame_durations, hidden_folders, track_acceptance)}

ORACLE = {
    "report_errors": f"SELECT image_id, line_no, split_part(errors, ',', 1) AS first_error FROM (SELECT * FROM ({L.ORACLE['label_parse_strict']})) WHERE errors <> '' ORDER BY image_id, line_no LIMIT 40",
    "report_orphans": f"SELECT * FROM ({L.ORACLE['orphan_labels']}) ORDER BY path LIMIT 20",
    "bench_cycle": "WITH i AS (SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), n AS (SELECT least(120, count(*)) AS n FROM i) SELECT r AS run, image_id FROM range(300) t(r), n JOIN i ON k = r % n",
    "frame_durations": "SELECT event_id, CASE WHEN (event_id % 61 - 1) > 0 THEN round_even(2000 / (event_id % 61 - 1), 0)::BIGINT ELSE 40 END AS ms FROM events",
    "hidden_folders": f"""WITH f AS (SELECT page_id, regexp_extract(regexp_replace(url, '^[a-z]+://', ''), '^(.*)/[^/]*$', 1) AS rel_dir FROM pages)
SELECT page_id, rel_dir, len(list_filter(string_split(rel_dir, '/'), lambda s: starts_with(s, '.') OR s IN {HIDDEN})) > 0 AS hidden FROM f""",
    "track_acceptance": """WITH g AS (SELECT l_partkey AS clip, count(*) AS n FROM lineitem WHERE l_linenumber < 6 AND l_suppkey % 30 < 20 GROUP BY l_partkey)
SELECT p_partkey AS clip, coalesce(n, 0) AS n_good, CASE WHEN 50 + p_partkey % 100 BETWEEN 75 AND 135 THEN (50 + p_partkey % 100) / 100 ELSE 1.0::DOUBLE END AS scale,
  coalesce(n, 0) >= 6 AND p_size >= 4 AND p_size + p_partkey % 3 - 1 >= 4 AS accepted FROM part LEFT JOIN g ON clip = p_partkey""",
}
