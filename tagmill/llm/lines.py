"""Removal of repeated passages by content-defined line chunks, with DataFrame functions only.

A text's lines are hashed (blank ones are passed over). A rolling hash over the last two line hashes ends a chunk where it
is divisible by ``divisor``, so boundaries depend on nearby content alone and come back after an insertion. Chunks of two
lines or more are looked up in the whole corpus. A passage also has an end on each side that lies in a chunk with foreign
lines, and a passage of few lines may hold no whole chunk; so the shortest runs of lines with ``long_words`` words or more
that begin or end at a line are looked up as well. Together they reach every line of a repeated passage of that many words.

A chunk or run that occurs more than once is compared byte for byte with its other occurrences; its first occurrence (by
doc_id, position, MD5 of the text) stays, and the lines of all others are removed, but for those that overlap the first.

Cases: null and empty texts stay as they are; rows that repeat both doc_id and text count as one document and are
treated alike; a null doc_id sorts first; an empty table gives an empty result; other columns are carried along, whatever
their names, but a column called like ``removed_col``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import hot_keys
from .common import WORD, cut, table

LONG_WORDS, MIN_WORDS, DIVISOR, BASE = 50, 12, 3, 31


def _bind(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))


def _chunks(of: Column, min_words: int, divisor: int) -> Column:
    """The spans (from 1) of content-defined chunks of at least two lines and min_words words."""

    def last(i: Column) -> Column:
        before = F.coalesce(F.get(of, i - 2)["h"], F.lit(0))
        return (i == F.size(of)) | (F.pmod(F.get(of, i - 1)["h"] * BASE + before, F.lit(divisor)) == 0)

    def spans(at: Column) -> Column:
        return F.transform(at, lambda end, k: _span(F.coalesce(F.get(at, k - 1), F.lit(0)) + 1, end))

    def fit(x: Column) -> Column:
        return (x["e"] > x["s"]) & (F.aggregate(F.slice(of, x["s"], x["e"] - x["s"] + 1), F.lit(0), lambda n, y: n + y["words"]) >= min_words)

    return F.filter(_bind(F.filter(F.sequence(F.lit(1), F.size(of)), last), spans), fit)


def _runs(of: Column, long_words: int) -> Column:
    """The spans of the shortest runs of long_words words or more that begin, or end, at each line."""

    def reach(part: Column) -> Column:
        """How many of the first items it takes, and the words they have."""
        start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("n"))
        return F.aggregate(part, start, lambda a, x: F.when(a["n"] >= long_words, a).otherwise(F.struct((a["k"] + 1).alias("k"), (a["n"] + x["words"]).alias("n"))))

    def most(i: Column) -> Column:
        return F.when(F.get(of, i - 1)["words"] >= long_words, 1).otherwise(long_words)  # every line has a word

    def ahead(i: Column) -> Column:
        return _bind(reach(F.slice(of, i, most(i))), lambda a: F.when(a["n"] >= long_words, _span(i, i + a["k"] - 1)))

    def back(i: Column) -> Column:
        first = F.greatest(F.lit(1), i - most(i) + 1)
        return _bind(reach(F.reverse(F.slice(of, first, i - first + 1))), lambda a: F.when(a["n"] >= long_words, _span(i - a["k"] + 1, i)))

    every = F.sequence(F.lit(1), F.size(of))
    return F.filter(F.concat(F.transform(every, ahead), F.transform(every, back)), lambda x: x.isNotNull())


def units(text: Column, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, divisor: int = DIVISOR) -> Column:
    """A text's chunks and runs: array<struct<s, e (first and last line, from 0), h, g (a hash of 128 bits)>>."""

    def line(x: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")
        return F.struct(i.alias("p"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("x"), h.alias("h"))

    def hashed(of: Column, x: Column) -> Column:
        lines = F.transform(F.slice(of, x["s"], x["e"] - x["s"] + 1), lambda y: y["x"])
        return _bind(lines, lambda a: F.struct(F.get(of, x["s"] - 1)["p"].alias("s"), F.get(of, x["e"] - 1)["p"].alias("e"), F.xxhash64(a).alias("h"), F.xxhash64(F.lit(1), a).alias("g")))

    def found(of: Column) -> Column:
        spans = F.array_distinct(F.concat(_chunks(of, min_words, divisor), _runs(of, long_words)))
        return F.when(F.size(of) > 0, F.transform(spans, lambda x: hashed(of, x)))

    return _bind(F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x["words"] > 0), found)


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, divisor: int = DIVISOR, removed_col: str = "_n_removed") -> DataFrame:
    """``docs`` with repeated passages removed from the text, and the number of lines removed as ``removed_col``."""
    names = [c for c in docs.columns if c != removed_col]
    # Columns go by number, so that no name clashes.
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    base = base.withColumn("th", F.xxhash64(text))
    found = base.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), "th", F.explode(units(F.col(text), long_words, min_words, divisor)).alias("u"))
    found = cut(found.select("id", "th", "u.s", "u.e", "u.h", "u.g").distinct())  # rows that repeat are one document from here on
    n = found.count()
    hot = hot_keys(found, "h", n)
    hot = cut(hot) if hot.take(1) else None

    def met(by: DataFrame) -> DataFrame:
        """The rows found that have a partner in ``by`` (one row a hash); those of hot hashes meet it by a broadcast."""
        if hot is None:
            return found.join(by, ["h", "g"])
        few = F.broadcast(by.join(F.broadcast(hot), "h", "left_semi"))
        return found.join(F.broadcast(hot), "h", "left_anti").join(by, ["h", "g"]).unionByName(found.join(few, ["h", "g"]))

    # Hashes first: only what occurs more than once is looked up in its text and compared.
    again = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    asked = met(again).groupBy("id", "th").agg(F.collect_list(F.struct("s", "e", "h", "g")).alias("of")).withColumnsRenamed({"id": "aid", "th": "ath"})

    def same_document(other: DataFrame, i: str, t: str) -> Column:
        return F.col(key).eqNullSafe(other[i]) & (F.col("th") == other[t])

    seen = base.join(asked, same_document(asked, "aid", "ath")).select(F.col(key).alias("id"), "th", F.md5(text).alias("md5"), F.split(text, "\n", -1).alias("lines"), F.explode("of").alias("u"))
    bytes_ = F.array_join(F.filter(F.slice("lines", F.col("u.s") + 1, F.col("u.e") - F.col("u.s") + 1), lambda x: x.rlike(WORD)), "\n")
    seen = seen.select("id", "th", "md5", "u.s", "u.e", "u.h", "u.g", bytes_.alias("t"))
    place = F.struct("id", "s", "e", "md5", "th")
    first = seen.groupBy("h", "g").agg(F.min(place).alias("first"), F.min("t").alias("low"), F.max("t").alias("high")).where("low = high").select("h", "g", "first")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th"))
    late = met(first).where(~(own & (F.col("s") <= F.col("first.e"))))
    gone = late.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("s", "e")))).alias("gone")).withColumnsRenamed({"id": "gid", "th": "gth"})

    out = base.join(gone, same_document(gone, "gid", "gth"), "left")
    kept = _bind(F.split(text, "\n", -1), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i)))
    some = F.size("gone") > 0
    out = out.withColumn(text, F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)))
    removed = F.when(some, F.size("gone")).otherwise(0).cast("long").alias(removed_col)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], removed)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_chunks(docs).select("doc_id", F.col("_n_removed").alias("n_removed"), "text")


LINES_SQL = r"""
lns AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p
  FROM (SELECT DISTINCT doc_id, text FROM {documents} WHERE text IS NOT NULL)),
facts AS (
  SELECT *, row_number() OVER d AS k, sum(words) OVER d AS upto, h * 31 + coalesce(lag(h) OVER d, 0) AS rolled, p = max(p) OVER (PARTITION BY doc_id, text) AS final
  FROM (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words, ('0x' || substr(md5(l), 1, 7))::BIGINT AS h FROM lns) WHERE words > 0
  WINDOW d AS (PARTITION BY doc_id, text ORDER BY p)),
nums AS (
  SELECT *, coalesce(sum(CASE WHEN rolled % 3 = 0 OR final THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM facts),
spans AS (
  SELECT doc_id, text, min(k) AS s, max(k) AS e FROM nums GROUP BY doc_id, text, c HAVING count(*) > 1 AND sum(words) >= 12
  UNION
  SELECT a.doc_id, a.text, a.k, min(b.k) FROM facts a JOIN facts b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND b.k BETWEEN a.k AND a.k + 49
  WHERE b.upto - a.upto + a.words >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, b.text, max(a.k), b.k FROM facts a JOIN facts b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.text = b.text AND a.k BETWEEN b.k - 49 AND b.k
  WHERE b.upto - a.upto + a.words >= 50 GROUP BY ALL),
whole AS (
  SELECT s.doc_id, s.text, min(f.p) AS s, max(f.p) AS e, string_agg(f.l, chr(10) ORDER BY f.k) AS t
  FROM spans s JOIN facts f ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.text = f.text AND f.k BETWEEN s.s AND s.e GROUP BY s.doc_id, s.text, s.s, s.e),
ordered AS (
  SELECT *, row_number() OVER o AS n, first_value(doc_id) OVER o AS first_id, first_value(text) OVER o AS first_text, first_value(e) OVER o AS first_e
  FROM whole WINDOW o AS (PARTITION BY t ORDER BY doc_id NULLS FIRST, s, e, md5(text))),
gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(s, e + 1)) AS p FROM ordered
  WHERE n > 1 AND NOT (doc_id IS NOT DISTINCT FROM first_id AND text = first_text AND s <= first_e)),
rebuilt AS (
  SELECT l.doc_id, l.text, count(g.p) AS n_removed, coalesce(string_agg(l.l, chr(10) ORDER BY l.p) FILTER (g.p IS NULL), '') AS left_text
  FROM lns l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.text = g.text AND l.p = g.p GROUP BY l.doc_id, l.text)"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE = {
    "op7_line_dedup": "WITH " + LINES_SQL.format(documents="documents") + """
SELECT d.doc_id, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.left_text, d.text) AS text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.text = r.text"""
}
