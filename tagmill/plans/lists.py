"""Queries of selections, paths that are added to a list, and how many images are labelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.autolabel import selections
from ..operators.resolve import newly_added
from . import labelling as L
from . import views as V


def class_selections(spark, sf_dir):
    """For each image the filter that the classes predicted on it make of those drawn on it."""
    found = selections(V.pred(spark, sf_dir).select("image_id", "cls"), V.gt(spark, sf_dir).select("image_id", "cls"), "image_id")
    return found.select("image_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("classes", "unknown")])


def _addresses(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"), "page_id")


def paths_added(spark, sf_dir):
    """Addresses of pages that the first third of the list doesn't hold yet, without what follows ? or #."""
    rows = _addresses(spark, sf_dir)
    return newly_added(rows.where("page_id % 3 <> 0"), rows.where("page_id % 3 = 0"), "page_id")


def labelled_counter(spark, sf_dir):
    """Images by state, and how many of them have a line of labels that is kept."""
    kept = L.label_parse_strict(spark, sf_dir).where("kept").select("image_id").distinct().withColumn("has", F.lit(True))
    rows = V.images(spark, sf_dir).join(kept, "image_id", "left")
    return rows.groupBy("rel_dir").agg(F.count(F.lit(1)).alias("images"), F.count_if("has").alias("labelled"))


QUERIES = {f.__name__: f for f in (class_selections, paths_added, labelled_counter)}

ORACLE = {
    "class_selections": f"""WITH {V.BOTH}, k AS (SELECT image_id, list_sort(list(DISTINCT cls)) AS k FROM gt GROUP BY image_id), c AS (SELECT image_id, list_sort(list(DISTINCT cls)) AS c FROM pred GROUP BY image_id),
b AS (SELECT image_id, k, coalesce(c, []) AS c FROM k LEFT JOIN c USING (image_id))
SELECT image_id, CASE WHEN len(list_intersect(k, c)) < len(k) THEN array_to_string(list_sort(list_intersect(k, c)), ',') END AS classes,
  array_to_string(list_filter(c, lambda x: NOT list_contains(k, x)), ',') AS unknown FROM b""",
    "paths_added": """WITH a AS (SELECT regexp_replace(url, '[?#].*$', '') AS path, page_id FROM pages)
SELECT path, min(page_id) AS page_id FROM a WHERE page_id % 3 <> 0 AND path NOT IN (SELECT path FROM a WHERE page_id % 3 = 0 AND path IS NOT NULL) GROUP BY path""",
    "labelled_counter": f"""WITH l AS ({L.ORACLE["label_parse_strict"]}), {V.IMAGES}
SELECT rel_dir, count(*) AS images, count(*) FILTER (image_id IN (SELECT image_id FROM l WHERE kept)) AS labelled FROM images GROUP BY rel_dir""",
}
