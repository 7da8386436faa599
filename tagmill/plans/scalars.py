"""Names, labels and report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.numbering import ranked_within
from . import views as V


def safe_names(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" / ", "p_name", "p_brand", F.when(F.expr("p_partkey % 5 = 0"), "é  ü")).alias("t"))
    return p.select("p_partkey", X.safe_name(F.when(F.expr("p_partkey % 50 = 7"), "  ").otherwise(F.col("t"))).alias("name"))


def out_stems(spark, sf_dir):
    i = V.images(spark, sf_dir)
    deep = F.regexp_replace("path", "/frame_", "/camera/frame.x_")
    return i.select("image_id", X.out_stem(F.when(F.expr("image_id % 2 = 0"), deep).otherwise(F.col("path")), F.lit("/data")).alias("inside"), X.out_stem(F.col("path"), F.lit("/other")).alias("outside"))


def label_paths(spark, sf_dir):
    return V.images(spark, sf_dir).select("image_id", X.label_path(F.col("path"), F.lit("/data"), F.lit("/labels")).alias("label"))


def human_sizes(spark, sf_dir):
    # The cube leaves a long above 2,097,151; the rest of the cube is that of the rests, whose products fit a decimal.
    rest = "cast({} % 4000000000000 as decimal(13, 0))"
    e = V.table(spark, sf_dir, "events").withColumn("r", F.expr(rest.format("event_id"))).withColumn("rr", F.expr(rest.format("(r * r)")))
    e = e.select("event_id", F.expr("cast((rr * r) % 4000000000000 as long)").alias("n"))
    return e.select("event_id", "n", X.human_size(F.col("n")).alias("size"))


def text_bars(spark, sf_dir):
    n = V.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.select("p_brand", X.text_bar(F.col("n"), F.max("n").over(V.W.partitionBy()), 18).alias("bar"))


def hex_bgr(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 6)).alias("c"))
    return p.select("p_partkey", *[x.alias(k) for k, x in X.hex_to_bgr(F.col("c")).items()])


def group_keys(spark, sf_dir):
    i = V.images(spark, sf_dir).withColumn("g", F.when(F.expr("image_id % 3 = 0"), F.col("image_id") % 100))
    return i.select("image_id", *[X.group_key(m, F.col("path"), F.lit("/data"), F.col("g"), F.col("image_id")).alias(m) for m in ("dup", "folder", "prefix", "none")])


def unique_names_suffix(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    names = ranked_within(p, "p_name", "p_partkey", name="k").select("p_partkey", "p_brand", X.numbered_name(F.col("p_name"), F.col("k")).alias("name"))
    labels = ranked_within(names.withColumn("base", X.label_base(F.when(F.expr("p_partkey % 40 = 3"), " ").otherwise(F.col("p_brand")))), "base", "p_partkey", name="k")
    return labels.select("p_partkey", "name", X.numbered_label(F.col("base"), F.col("k")).alias("label"))


def class_summaries(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("names"))
    return p.select("p_type", X.class_summary(F.col("names"), 4).alias("summary"))


def clip_next_index(spark, sf_dir):
    """The number of the next clip of each conversation, whose turns are clips."""
    c = V.table(spark, sf_dir, "conversations").select("conv_id", X.clip_name(F.lit("a_"), F.col("turn") * 37, F.lit(".mp4")).alias("name"))
    return c.groupBy("conv_id").agg((F.coalesce(F.max(X.clip_index(F.col("name"))), F.lit(0)) + 1).alias("next"))


def clip_order(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clip_name(F.lit("a_"), F.col("turn") * 370, F.lit(".mp4")).alias("name"))
    rows = ranked_within(c.withColumn("n", X.clip_index(F.col("name"))), "conv_id", "n", name="place")
    return rows.select("conv_id", "turn", "name", "place")


QUERIES = {f.__name__: f for f in (safe_names, out_stems, label_paths, human_sizes, text_bars, hex_bgr, group_keys, unique_names_suffix, class_summaries, clip_next_index, clip_order)}

_CLIP = "'a_clip_' || CASE WHEN length({n}) < 3 THEN lpad({n}, 3, '0') ELSE {n} END || '.mp4'"
ORACLE = {
    "safe_names": r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN '  ' ELSE p_name || ' / ' || p_brand || CASE WHEN p_partkey % 5 = 0 THEN ' / é  ü' ELSE '' END END AS t FROM part),
q AS (SELECT p_partkey, regexp_replace(trim(regexp_replace(trim(t), '[^\p{L}\p{N}\-_ ]', '_', 'g')), ' +', '_', 'g') AS n FROM p) SELECT p_partkey, CASE WHEN n = '' THEN 'model' ELSE n END AS name FROM q""",
    "out_stems": f"""WITH {V.IMAGES} SELECT image_id, CASE WHEN image_id % 2 = 0 THEN rel_dir || '_camera_frame.x_' || image_id ELSE rel_dir || '_' || stem END AS inside, stem AS outside FROM images""",
    "label_paths": f"WITH {V.IMAGES} SELECT image_id, '/labels/' || rel_dir || '/' || stem || '.txt' AS label FROM images",
    "human_sizes": """WITH e AS (SELECT event_id, ((event_id * event_id * event_id) % 4000000000000)::BIGINT AS n FROM events)
SELECT event_id, n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM e""",
    "text_bars": "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, repeat('█', round_even(18 * n / max(n) OVER (), 0)::INT) AS bar FROM n",
    "hex_bgr": "WITH p AS (SELECT p_partkey, substr(md5(p_partkey::VARCHAR), 1, 6) AS c FROM part) SELECT p_partkey, ('0x' || substr(c, 5, 2))::INT AS b, ('0x' || substr(c, 3, 2))::INT AS g, ('0x' || substr(c, 1, 2))::INT AS r FROM p",
    "group_keys": f"""WITH {V.IMAGES} SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 'dup' || (image_id % 100) ELSE 'tek' || image_id END AS dup, rel_dir AS folder, 'frame' AS prefix, 'tek' || image_id AS "none" FROM images""",
    "unique_names_suffix": """WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k, CASE WHEN p_partkey % 40 = 3 THEN 'Model' ELSE p_brand END AS base FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS j FROM p)
SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '__' || k END AS name, CASE WHEN j = 1 THEN base ELSE base || ' (' || j || ')' END AS label FROM q""",
    "class_summaries": """WITH p AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS names FROM part GROUP BY p_type)
SELECT p_type, len(names) || ' classes: ' || array_to_string(names[1:4], ', ') || CASE WHEN len(names) > 4 THEN '… (+' || (len(names) - 4) || ')' ELSE '' END AS summary FROM p""",
    "clip_next_index": "SELECT conv_id, max(turn * 37) + 1 AS next FROM conversations GROUP BY conv_id",
    "clip_order": f"SELECT conv_id, turn, {_CLIP.format(n='(turn * 370)::VARCHAR')} AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations",
}
