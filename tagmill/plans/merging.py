"""Class vocabularies, merges, imports and edits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import edits as E
from ..operators import remap as R
from ..operators import tracking as T
from . import labelling as L
from . import views as V

#: Two sources' classes; the target is their ordered union, of which A's class 3 is left out.
SOURCES = [("A", 0, i, n) for i, n in enumerate(("lorry", "wagon", "trailer", "bus"))] + [("B", 1, i, n) for i, n in enumerate(("wagon", "trailer", "minibus", "lorry", "motor"))]
_VALUES = ", ".join(f"('{s}', {k}, {i}, '{n}')" for s, k, i, n in SOURCES)
_CLASSES = f"""cl AS (SELECT * FROM (VALUES {_VALUES}) t(source, source_no, cls, name)),
target AS (SELECT name, (row_number() OVER (ORDER BY min(source_no * 1000 + cls)) - 1)::INT AS cls FROM cl GROUP BY name),
cm AS (SELECT source, cl.cls AS src_cls, CASE WHEN source = 'A' AND cl.cls = 3 THEN NULL ELSE t.cls END AS dst_cls FROM cl LEFT JOIN target t USING (name))"""


_PART_CLASSES = """pc AS (
  SELECT ['A', 'B', 'C'][s + 1] AS source, s::INT AS source_no, (row_number() OVER (PARTITION BY s ORDER BY min(p_partkey)) - 1)::INT AS cls, lower(p_type) || ' ' || string_split(p_name, ' ')[-1] AS name
  FROM part, range(3) t(s) WHERE p_partkey % (s + 2) = 0 GROUP BY s, lower(p_type) || ' ' || string_split(p_name, ' ')[-1])"""


def _classes(spark):
    return spark.createDataFrame(SOURCES, "source string, source_no int, cls int, name string")


def _map(spark):
    found = R.auto_map(_classes(spark), R.ordered_union(_classes(spark)))
    return found.withColumn("dst_cls", F.when((F.col("source") == "A") & (F.col("src_cls") == 3), None).otherwise(F.col("dst_cls")))


def _part_classes(spark, sf_dir):
    """source, source_no, cls, name: three overlapping sources' classes, named after parts and numbered as first met."""
    p = V.table(spark, sf_dir, "part").selectExpr("p_partkey", "concat_ws(' ', lower(p_type), element_at(split(p_name, ' '), -1)) AS name", "explode(sequence(0, 2)) AS source_no")
    first = p.where("p_partkey % (source_no + 2) = 0").groupBy("source_no", "name").agg(F.min("p_partkey").alias("at"))  # a row a name reaches the window
    number = F.row_number().over(W.partitionBy("source_no").orderBy("at")) - 1
    return first.select(F.expr("element_at(array('A', 'B', 'C'), source_no + 1)").alias("source"), "source_no", number.cast("int").alias("cls"), "name")


def class_union_ordered(spark, sf_dir):
    return R.ordered_union(_part_classes(spark, sf_dir))


def class_automap(spark, sf_dir):
    known = _part_classes(spark, sf_dir)
    return R.auto_map(known, R.ordered_union(known.where("source <> 'C'")))


def class_remap_merge(spark, sf_dir):
    return R.apply_map(V.raw_boxes(spark, sf_dir), _map(spark)).select("image_id", "gi", "source", "dst_cls")


def _source():
    return F.when(F.expr("image_id % 2 = 0"), "A").otherwise("B")


def _merged(spark, sf_dir):
    from ..operators.labels import parse_merge

    return R.merge_lines(parse_merge(L.label_lines(spark, sf_dir)).withColumn("source", _source()), _map(spark))


def class_remap_lines(spark, sf_dir):
    return _merged(spark, sf_dir).select("image_id", "line_no", "fate", "line")


def class_remap_rollup(spark, sf_dir):
    images = V.images(spark, sf_dir).withColumn("source", _source())
    return R.merge_counts(images.select("source", "image_id"), _merged(spark, sf_dir))


def merge_class_counts(spark, sf_dir):
    """Boxes of each target class, 0 included."""
    target = R.ordered_union(_classes(spark))
    counts = R.apply_map(V.raw_boxes(spark, sf_dir), _map(spark)).groupBy("dst_cls").agg(F.count(F.lit(1)).alias("n"))
    return target.join(counts, target.cls == counts.dst_cls, "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def source_class_counts(spark, sf_dir):
    return R.source_counts(V.raw_boxes(spark, sf_dir))


def merged_names(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    name = F.concat(F.regexp_replace("p_brand", "#", ""), F.when(F.expr("p_partkey % 2 = 0"), ".jpg").otherwise(".png"))
    prefix = F.when(F.expr("p_partkey % 3 = 0"), "").otherwise("src")
    return R.merged_names(parts, prefix, name, F.col("p_partkey")).select("p_partkey", "out_name")


def first_seen_ids(spark, sf_dir):
    return R.first_seen_ids(V.table(spark, sf_dir, "part"), "p_type", "p_partkey")


def _imported(spark, sf_dir):
    return R.import_boxes(V.raw_boxes(spark, sf_dir), _map(spark), F.lit(float(V.WIDTH)), F.lit(float(V.HEIGHT)))


def import_boxes(spark, sf_dir):
    return _imported(spark, sf_dir).select("image_id", "gi", "reason", "clipped", "dst_cls", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "nw", "nh")])


def import_reason_counts(spark, sf_dir):
    images = V.images(spark, sf_dir).select("image_id", F.expr("image_id % 13 <> 0").alias("exists"), F.expr("image_id % 17 <> 0").alias("has_size"))
    return R.import_counts(images, _imported(spark, sf_dir))


def class_remove_remap(spark, sf_dir):
    names = spark.range(V.CLASSES).select(F.col("id").cast("int").alias("cls"))
    new = R.removed_class_map(names, 2)
    boxes = V.gt(spark, sf_dir)
    return boxes.join(new.where("dst_cls IS NOT NULL"), boxes.cls == new.src_cls).select("image_id", "gi", F.col("dst_cls").alias("cls"))


#: Changes by residues of image and box: deletions, new classes (some too high), moves, boxes deleted and drawn anew.
_LOG = [
    "SELECT image_id, gi, 1 AS seq, 'delete' AS op, cls, x1, y1, x2, y2 FROM gt WHERE (image_id + gi) % 5 = 0",
    "SELECT image_id, gi, 2 AS seq, 'class' AS op, cast(cls + 3 as int) AS cls, x1, y1, x2, y2 FROM gt WHERE (image_id + gi) % 3 = 0",
    "SELECT image_id, gi, 3 AS seq, 'move' AS op, cls, x1 + 5 AS x1, y1 + 5 AS y1, x2 + 5 AS x2, y2 + 5 AS y2 FROM gt WHERE (image_id + gi) % 4 = 0",
    "SELECT image_id, gi, 4 AS seq, 'add' AS op, cast(1 as int) AS cls, x1, y1, x2, y2 FROM gt WHERE (image_id + gi) % 10 = 0",
    "SELECT image_id, 100 + gi AS gi, 5 AS seq, 'add' AS op, cast(2 as int) AS cls, x1 + 1 AS x1, y1, x2 + 1 AS x2, y2 FROM gt WHERE (image_id + gi) % 7 = 0",
]


def edit_log_apply(spark, sf_dir):
    boxes = V.gt(spark, sf_dir)
    changes = [
        boxes.where("(image_id + gi) % 5 = 0").withColumn("seq", F.lit(1)).withColumn("op", F.lit("delete")),
        boxes.where("(image_id + gi) % 3 = 0").withColumn("seq", F.lit(2)).withColumn("op", F.lit("class")).withColumn("cls", F.col("cls") + 3),
        boxes.where("(image_id + gi) % 4 = 0").withColumn("seq", F.lit(3)).withColumn("op", F.lit("move")).withColumns({c: F.col(c) + 5 for c in E.CORNERS}),
        boxes.where("(image_id + gi) % 10 = 0").withColumn("seq", F.lit(4)).withColumn("op", F.lit("add")).withColumn("cls", F.lit(1)),
        boxes.where("(image_id + gi) % 7 = 0").withColumn("gi", F.col("gi") + 100).withColumn("seq", F.lit(5)).withColumn("op", F.lit("add")).withColumn("cls", F.lit(2)).withColumns({c: F.col(c) + 1 for c in ("x1", "x2")}),
    ]
    log = changes[0]
    for more in changes[1:]:
        log = log.unionByName(more)
    return E.apply_log(boxes, log, V.CLASSES)


def edit_saved_copy(spark, sf_dir):
    return E.saved_copy(V.gt(spark, sf_dir), V.WIDTH, V.HEIGHT)


def propagate_take_while(spark, sf_dir):
    """Turns of each conversation before the first that counts as labelled, five at most."""
    frames = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr("(conv_id + 3 * turn) % 11 = 0").alias("labelled"))
    return T.take_while(frames, ["conv_id"], "turn", "labelled", 5).select("conv_id", "turn", "role")


def json_props(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


def coco_explode_join(spark, sf_dir):
    """Boxes nested by image as in a COCO file, taken apart and joined to their images again."""
    from ..sources.coco import boxes_of

    raw = V.raw_boxes(spark, sf_dir)
    annotations = raw.select(F.col("image_id"), F.col("src_cls").cast("long").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), F.col("flagged").cast("int").alias("iscrowd"))
    images = V.images(spark, sf_dir).where("rel_dir <> 'P'").select(F.col("image_id").alias("id"), F.concat("stem", F.lit(".jpg")).alias("file_name"), F.lit(None).cast("string").alias("filename"), F.lit(V.WIDTH).alias("width"), F.lit(V.HEIGHT).alias("height"))
    found = boxes_of(images, annotations)
    return found.groupBy("image_id", "src_cls").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.sum(F.col("w") * F.col("h")).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (
        class_union_ordered, class_automap, class_remap_merge, class_remap_lines, class_remap_rollup, merge_class_counts, source_class_counts, merged_names,
        first_seen_ids, import_boxes, import_reason_counts, class_remove_remap, edit_log_apply, edit_saved_copy, propagate_take_while, json_props, coco_explode_join,
    )
}

_MERGE = f"""{L._TOKENS}, {_CLASSES}, ml AS (
  SELECT CASE WHEN image_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, image_id, line_no, trunc(c)::INT AS src_cls, array_to_string(t[2:], ' ') AS rest FROM v),
fates AS (SELECT ml.*, CASE WHEN ml.src_cls IS NULL THEN 'error' WHEN dst_cls IS NULL THEN 'dropped' ELSE 'box' END AS fate, dst_cls FROM ml LEFT JOIN cm ON cm.source = ml.source AND cm.src_cls = ml.src_cls)"""
_IMPORT = f"""WITH {V.RAW}, {_CLASSES}, im AS (
  SELECT raw.*, dst_cls, greatest(0, x) AS a, greatest(0, y) AS b, least(640, x + w) AS c, least(480, y + h) AS d FROM raw LEFT JOIN cm ON cm.source = raw.source AND cm.src_cls = raw.src_cls),
im2 AS (SELECT *, CASE WHEN flagged THEN 'flagged' WHEN dst_cls IS NULL THEN 'unmapped' WHEN c - a <= 1e-6 OR d - b <= 1e-6 THEN 'invalid' WHEN NOT (c - a > 0 AND c - a <= 640 AND d - b > 0 AND d - b <= 480) THEN 'invalid' ELSE 'box' END AS reason,
  NOT flagged AND dst_cls IS NOT NULL AND c - a > 1e-6 AND d - b > 1e-6 AND (a <> x OR b <> y OR c <> x + w OR d <> y + h) AS clipped FROM im)"""

ORACLE = {
    "class_union_ordered": f"WITH {_PART_CLASSES} SELECT name, (row_number() OVER (ORDER BY min(source_no * 1000000 + cls)) - 1)::INT AS cls FROM pc GROUP BY name",
    "class_automap": f"""WITH {_PART_CLASSES}, t AS (SELECT name, (row_number() OVER (ORDER BY min(source_no * 1000000 + cls)) - 1)::INT AS cls FROM pc WHERE source <> 'C' GROUP BY name)
SELECT source, pc.cls AS src_cls, t.cls AS dst_cls FROM pc LEFT JOIN t USING (name)""",
    "class_remap_merge": f"WITH {V.RAW}, {_CLASSES} SELECT image_id, gi, raw.source, dst_cls FROM raw JOIN cm ON cm.source = raw.source AND cm.src_cls = raw.src_cls WHERE dst_cls IS NOT NULL",
    "class_remap_lines": f"{_MERGE} SELECT image_id, line_no, fate, CASE WHEN fate = 'box' THEN concat_ws(' ', dst_cls::VARCHAR, nullif(rest, '')) END AS line FROM fates",
    "class_remap_rollup": f"""{_MERGE}, {V.IMAGES}, per AS (SELECT image_id, count(*) FILTER (fate = 'box') AS box, count(*) FILTER (fate = 'dropped') AS dropped, count(*) FILTER (fate = 'error') AS error FROM fates GROUP BY image_id),
ims AS (SELECT CASE WHEN image_id % 2 = 0 THEN 'A' ELSE 'B' END AS source, box, dropped, error FROM images LEFT JOIN per USING (image_id))
SELECT source, count(*) FILTER (coalesce(box, 0) > 0) AS images, coalesce(sum(box), 0)::BIGINT AS boxes, coalesce(sum(dropped), 0)::BIGINT AS dropped, coalesce(sum(error), 0)::BIGINT AS errors,
  count(*) FILTER (box IS NULL) AS unlabelled, count(*) FILTER (coalesce(box, 0) = 0) AS skipped_empty FROM ims GROUP BY ROLLUP (source)""",
    "merge_class_counts": f"WITH {V.RAW}, {_CLASSES} SELECT t.name, (SELECT count(*) FROM raw JOIN cm ON cm.source = raw.source AND cm.src_cls = raw.src_cls WHERE dst_cls = t.cls) AS n FROM target t",
    "source_class_counts": f"WITH {V.RAW} SELECT source, src_cls, count(*) AS n FROM raw GROUP BY ALL",
    "merged_names": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'src_' END || replace(p_brand, '#', '') AS stem, CASE WHEN p_partkey % 2 = 0 THEN '.jpg' ELSE '.png' END AS ext FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY p_partkey) - 1 AS k FROM p) SELECT p_partkey, stem || CASE WHEN k = 0 THEN '' ELSE '__' || k END || ext AS out_name FROM k""",
    "first_seen_ids": "SELECT trim(p_type) AS name, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::INT AS id FROM part WHERE trim(p_type) <> '' GROUP BY trim(p_type)",
    "import_boxes": f"""{_IMPORT} SELECT image_id, gi, reason, clipped, dst_cls, CASE WHEN reason = 'box' THEN round((a + c) / 2 / 640, 8) END AS cx, CASE WHEN reason = 'box' THEN round((b + d) / 2 / 480, 8) END AS cy,
  CASE WHEN reason = 'box' THEN round((c - a) / 640, 8) END AS nw, CASE WHEN reason = 'box' THEN round((d - b) / 480, 8) END AS nh FROM im2""",
    "import_reason_counts": f"""{_IMPORT}, {V.IMAGES}, per AS (SELECT image_id, count(*) FILTER (reason = 'box') AS box, count(*) FILTER (reason = 'flagged') AS flagged, count(*) FILTER (reason = 'unmapped') AS unmapped,
  count(*) FILTER (reason = 'invalid') AS invalid, count(*) FILTER (clipped) AS clipped FROM im2 WHERE image_id % 13 <> 0 AND image_id % 17 <> 0 GROUP BY image_id),
j AS (SELECT image_id % 13 <> 0 AND image_id % 17 <> 0 AS good, per.* FROM images LEFT JOIN per USING (image_id))
SELECT count(*) FILTER (good AND coalesce(box, 0) > 0) AS images, count(*) FILTER (NOT good) AS missing, sum(box)::BIGINT AS boxes, sum(clipped)::BIGINT AS clipped, sum(flagged)::BIGINT AS flagged,
  sum(unmapped)::BIGINT AS unmapped, sum(invalid)::BIGINT AS invalid, count(*) FILTER (good AND coalesce(box, 0) = 0) AS skipped_empty FROM j""",
    "class_remove_remap": f"WITH {V.GT} SELECT image_id, gi, (CASE WHEN cls < 2 THEN cls ELSE cls - 1 END)::INT AS cls FROM gt WHERE cls <> 2",
    "edit_log_apply": f"""WITH {V.GT}, lg AS ({" UNION ALL ".join(_LOG)}),
life AS (SELECT * FROM lg WHERE op IN ('add', 'delete') QUALIFY row_number() OVER (PARTITION BY image_id, gi ORDER BY seq DESC) = 1),
base AS (SELECT coalesce(g.image_id, l.image_id) AS image_id, coalesce(g.gi, l.gi) AS gi, coalesce(l.seq, -1) AS born, CASE WHEN l.op IS NULL THEN g.cls ELSE l.cls END AS cls, CASE WHEN l.op IS NULL THEN g.x1 ELSE l.x1 END AS x1,
  CASE WHEN l.op IS NULL THEN g.y1 ELSE l.y1 END AS y1, CASE WHEN l.op IS NULL THEN g.x2 ELSE l.x2 END AS x2, CASE WHEN l.op IS NULL THEN g.y2 ELSE l.y2 END AS y2
  FROM gt g FULL JOIN life l ON g.image_id = l.image_id AND g.gi = l.gi WHERE l.op IS NULL OR l.op = 'add')
SELECT b.image_id, b.gi, least(6, CASE WHEN c.seq > born THEN c.cls ELSE b.cls END)::INT AS cls, CASE WHEN m.seq > born THEN m.x1 ELSE b.x1 END AS x1, CASE WHEN m.seq > born THEN m.y1 ELSE b.y1 END AS y1,
  CASE WHEN m.seq > born THEN m.x2 ELSE b.x2 END AS x2, CASE WHEN m.seq > born THEN m.y2 ELSE b.y2 END AS y2
FROM base b LEFT JOIN lg c ON c.op = 'class' AND c.image_id = b.image_id AND c.gi = b.gi LEFT JOIN lg m ON m.op = 'move' AND m.image_id = b.image_id AND m.gi = b.gi""",
    "edit_saved_copy": f"""WITH {V.GT}, n AS (SELECT image_id, gi, cls, (x1 + x2) / 2 / 640 AS cx, (y1 + y2) / 2 / 480 AS cy, abs(x2 - x1) / 640 AS w, abs(y2 - y1) / 480 AS h FROM gt)
SELECT image_id, gi, cls, trunc((cx - w / 2) * 640)::INT AS x1, trunc((cy - h / 2) * 480)::INT AS y1, trunc((cx + w / 2) * 640)::INT AS x2, trunc((cy + h / 2) * 480)::INT AS y2 FROM n""",
    "propagate_take_while": """WITH c AS (SELECT conv_id, turn, role, max(((conv_id + 3 * turn) % 11 = 0)::INT) OVER w AS s, row_number() OVER w AS k FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, role FROM c WHERE s = 0 AND k <= 5""",
    "json_props": "SELECT event_id, (props->>'k')::BIGINT AS k FROM events",
    "coco_explode_join": f"""WITH {V.RAW}, {V.IMAGES} SELECT image_id, src_cls, count(*) AS n, count(*) FILTER (flagged) AS n_flagged, sum(w * h) AS area FROM raw JOIN images USING (image_id) WHERE rel_dir <> 'P' GROUP BY ALL""",
}
