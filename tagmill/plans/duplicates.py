"""Near-duplicates, splits, leaks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contamination as C
from ..operators import neardup as N
from ..operators import numbering as S
from ..operators import split as P
from . import views as V

# Fixed value: up to this distance two hashes are near-duplicates.
TEXT_MOST = 5
#: Vectors hash less evenly: at a distance of up to 15 of 63 bits they are near-duplicates.
VECTOR_MOST = 15


def _texts(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.repartition("id").select("id", N.simhash("text").alias("h"))


def _vectors(spark, sf_dir):
    return V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), N.diffhash(F.col("embedding")).alias("h"))


def text_simhash(spark, sf_dir):
    return _texts(spark, sf_dir)


def vector_diffhash(spark, sf_dir):
    return _vectors(spark, sf_dir)


def hamming_pairs_banded(spark, sf_dir):
    return N.hamming_pairs(_texts(spark, sf_dir), TEXT_MOST, bits=60)


def hamming_pairs_vectors(spark, sf_dir):
    return N.hamming_pairs_blocked(_vectors(spark, sf_dir), VECTOR_MOST)


def _groups(spark, sf_dir):
    return N.duplicate_groups(S.cut(_texts(spark, sf_dir)), TEXT_MOST, bits=60)


def neardup_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("id", "dup_group")


def neardup_representatives(spark, sf_dir):
    return _groups(spark, sf_dir).where("dup_rep").select("id", "dup_group")


def neardup_stats(spark, sf_dir):
    return N.group_stats(_groups(spark, sf_dir))


def neardup_largest(spark, sf_dir):
    return N.largest_groups(_groups(spark, sf_dir))


def _keys(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return N.split_keys(docs, _groups(spark, sf_dir))


def neardup_line(spark, sf_dir):
    """The groups of documents as a line of text."""
    return N.group_line(_keys(spark, sf_dir))


def neardup_keys(spark, sf_dir):
    return _keys(spark, sf_dir)


def _split(spark, sf_dir):
    keys = S.cut(_keys(spark, sf_dir))
    return keys.join(P.assign_splits(keys.select("key"), (0.7, 0.2, 0.1)).select("key", "split").hint("merge"), "key")


def split_assign_md5(spark, sf_dir):
    return _split(spark, sf_dir).select("id", "key", "split")


def split_no_group_leak(spark, sf_dir):
    """Parts of each group, which are one each: the result is empty."""
    return _split(spark, sf_dir).groupBy("key").agg(F.countDistinct("split").alias("parts")).where("parts > 1")


def _image_split(spark, sf_dir):
    """Images in groups by customer."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("key"))
    return o.join(P.assign_splits(o.select("key"), (0.8, 0.2, 0.0)), "key").select("image_id", "key", "split")


def split_assign_images(spark, sf_dir):
    return _image_split(spark, sf_dir)


def split_stats(spark, sf_dir):
    names = spark.range(V.CLASSES).select(F.col("id").cast("int").alias("cls"), F.concat(F.lit("class_"), F.col("id").cast("string")).alias("name"))
    return P.split_stats(_image_split(spark, sf_dir), V.gt(spark, sf_dir), names)


def split_leak_groups(spark, sf_dir):
    """A split by id alone tears groups apart."""
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.expr("doc_id % 5 = 0"), "val").otherwise("train").alias("split"))
    return P.leaking_groups(_groups(spark, sf_dir), docs)


def split_leak_examples(spark, sf_dir):
    return split_leak_groups(spark, sf_dir).orderBy("dup_group").limit(5).select("dup_group", "first_left", "first_right")


def benchmark_contamination(spark, sf_dir):
    return C.contamination(V.table(spark, sf_dir, "documents").select("doc_id", "text"), V.table(spark, sf_dir, "benchmark"))


def systematic_sample(spark, sf_dir):
    return S.systematic_sample(V.table(spark, sf_dir, "events").select("event_id", "event_type"), 400, "event_id")


def head_sample(spark, sf_dir):
    return S.head_sample(V.table(spark, sf_dir, "events").select("event_id", "event_type"), 400, "event_id")


def row_numbers(spark, sf_dir):
    return S.numbered(V.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        text_simhash, vector_diffhash, hamming_pairs_banded, hamming_pairs_vectors, neardup_groups, neardup_representatives, neardup_stats, neardup_line, neardup_largest,
        neardup_keys, split_assign_md5, split_no_group_leak, split_assign_images, split_stats, split_leak_groups, split_leak_examples, benchmark_contamination,
        systematic_sample, head_sample, row_numbers,
    )
}

_HASHES = """words AS (SELECT doc_id AS id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents WHERE text IS NOT NULL),
bits AS (SELECT id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM (SELECT id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM words), range(60) t(i) GROUP BY id, i),
hashes AS (SELECT id, sum(CASE WHEN s > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS h FROM bits GROUP BY id)"""
_VECTORS = "hashes AS (SELECT vec_id AS id, list_sum(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1::BIGINT << (len(embedding) - 1 - i) ELSE 0 END))::BIGINT AS h FROM embeddings)"
_PAIRS = "SELECT DISTINCT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM hashes a JOIN hashes b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= {most}"
_GROUPS = f"""WITH RECURSIVE {_HASHES}, near AS (
  SELECT a.id AS u, b.id AS v FROM hashes a JOIN hashes b ON a.id <> b.id AND bit_count(xor(a.h, b.h)) <= {TEXT_MOST}),
reach AS (SELECT u AS id, u AS r FROM near UNION SELECT near.v, reach.r FROM reach JOIN near ON near.u = reach.id),
roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id),
grp AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS dup_group, id = root AS dup_rep FROM roots)"""
_KEYS = f"{_GROUPS}, keys AS (SELECT doc_id AS id, CASE WHEN dup_group IS NULL THEN 'tek' || doc_id ELSE 'dup' || dup_group END AS key FROM documents LEFT JOIN grp ON id = doc_id)"


def _fold_sql(ratios: tuple[float, float, float]) -> str:
    """The ordered filling as a recursion over the groups; the next free part has the largest gap, the first of equals."""
    gaps = [f"{r / sum(ratios)!r}::DOUBLE * total - {k}" if r > 0 else "-1e18" for r, k in zip(ratios, ("a", "b", "c"), strict=True)]
    pick = f"CASE WHEN {gaps[0]} >= {gaps[1]} AND {gaps[0]} >= {gaps[2]} THEN 'train' WHEN {gaps[1]} >= {gaps[2]} THEN 'val' ELSE 'test' END"
    return f"""turns AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY md5('42|' || key), key) AS k, sum(count(*)) OVER () AS total FROM keys GROUP BY key),
fill AS (
  SELECT 0::BIGINT AS k, NULL::VARCHAR AS key, NULL::VARCHAR AS split, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c
  UNION ALL
  SELECT k, key, pick, a + CASE WHEN pick = 'train' THEN n ELSE 0 END, b + CASE WHEN pick = 'val' THEN n ELSE 0 END, c + CASE WHEN pick = 'test' THEN n ELSE 0 END
  FROM (SELECT t.k, t.key, t.n, f.a, f.b, f.c, {pick} AS pick FROM fill f JOIN turns t ON t.k = f.k + 1))"""


_SPLIT = f"{_KEYS}, {_fold_sql((0.7, 0.2, 0.1))}, sp AS (SELECT id, key, split FROM keys JOIN fill USING (key))"
_IMAGES = f"WITH RECURSIVE keys AS (SELECT o_orderkey AS image_id, 'm' || o_custkey AS key FROM orders), {_fold_sql((0.8, 0.2, 0.0))}, sp AS (SELECT image_id, key, split FROM keys JOIN fill USING (key)), {V.GT}"
_LEAKS = f"""{_GROUPS}, lk AS (
  SELECT dup_group, count(*) FILTER (id % 5 <> 0) AS n_left, count(*) FILTER (id % 5 = 0) AS n_right, min(id) FILTER (id % 5 <> 0) AS first_left, min(id) FILTER (id % 5 = 0) AS first_right
  FROM grp GROUP BY dup_group HAVING n_left > 0 AND n_right > 0)"""
_SHINGLES = """SELECT {id}, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s
  FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= 8"""

ORACLE = {
    "text_simhash": f"WITH {_HASHES} SELECT doc_id AS id, h FROM documents LEFT JOIN hashes ON id = doc_id",
    "vector_diffhash": f"WITH {_VECTORS} SELECT id, h FROM hashes",
    "hamming_pairs_banded": f"WITH {_HASHES} {_PAIRS.format(most=TEXT_MOST)}",
    "hamming_pairs_vectors": f"WITH {_VECTORS} {_PAIRS.format(most=VECTOR_MOST)}",
    "neardup_groups": f"{_GROUPS} SELECT id, dup_group FROM grp",
    "neardup_representatives": f"{_GROUPS} SELECT id, dup_group FROM grp WHERE dup_rep",
    "neardup_stats": f"{_GROUPS} SELECT count(*) AS groups, (sum(n) - count(*))::BIGINT AS surplus, max(n) AS largest FROM (SELECT dup_group, count(*) AS n FROM grp GROUP BY dup_group)",
    "neardup_largest": f"""{_GROUPS}, t AS (SELECT dup_group, count(*) AS size, array_to_string(list_sort(list(id))[1:4], ',') AS ids FROM grp GROUP BY dup_group)
SELECT * FROM t ORDER BY size DESC, dup_group LIMIT 10""",
    "neardup_line": f"{_KEYS} SELECT format('{{}} images, {{}} groups (largest {{}})', sum(n)::BIGINT, count(*), max(n)) AS line FROM (SELECT key, count(*) AS n FROM keys GROUP BY key)",
    "neardup_keys": f"{_KEYS} SELECT id, key FROM keys",
    "split_assign_md5": f"{_SPLIT} SELECT id, key, split FROM sp",
    "split_no_group_leak": f"{_SPLIT} SELECT key, count(DISTINCT split) AS parts FROM sp GROUP BY key HAVING count(DISTINCT split) > 1",
    "split_assign_images": f"{_IMAGES} SELECT image_id, key, split FROM sp",
    "split_stats": f"""{_IMAGES} SELECT s.split, 'class_' || i AS name, images, (SELECT count(*) FROM sp JOIN gt USING (image_id) WHERE sp.split = s.split AND gt.cls = i) AS n
FROM (SELECT split, count(*) AS images FROM sp GROUP BY split) s, range(7) t(i)""",
    "split_leak_groups": f"{_LEAKS} SELECT * FROM lk",
    "split_leak_examples": f"{_LEAKS} SELECT dup_group, first_left, first_right FROM lk ORDER BY dup_group LIMIT 5",
    "benchmark_contamination": f"""WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
hits AS (SELECT item_id, doc_id, count(*) AS n, any_value(size) AS size FROM (SELECT item_id, len(s) AS size, unnest(s) AS h FROM b) JOIN (SELECT doc_id, unnest(s) AS h FROM d) USING (h) GROUP BY item_id, doc_id)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM hits WHERE n >= 0.5 * size GROUP BY item_id""",
    "systematic_sample": """WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS j, count(*) OVER () AS n FROM events)
SELECT event_id, event_type FROM e WHERE n <= 400 OR j IN (SELECT i * (SELECT count(*) FROM events) // 400 FROM range(400) t(i))""",
    "head_sample": "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 400",
    "row_numbers": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders",
}
