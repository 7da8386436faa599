"""Mixing sources to target weights with hash-threshold histograms.

Sizes are summed by source and hash bucket; a running sum over the buckets finds, for each source, the one bucket in
which its budget runs out; only that bucket is split further, until the full hash decides. Documents are then filtered
by comparing their hash to their source's threshold: no sort, and thresholds nest (a larger budget takes a superset).

Cases: a null text has size 0; null sources form one source, the last; rows that repeat a doc_id share its hash and so
are taken together; an empty table gives an empty result; other columns of the input are ignored by ``mix_sources`` and
carried along, whatever their names, by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, cut, table

HASH_BITS = 60
#: Up to so many sources (one row of five numbers each, a few MB) their table is broadcast.
BROADCAST_SOURCES = 20_000


def hash60(key: Column) -> Column:
    """The first 60 bits of a key's MD5; a null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order, null last, weigh ``weights``, repeating, and share the sum of all sizes. A target stops at ``most``
    times its source's size; the excess goes to the others by weight. That is one level L with target =
    min(most * size, L * weight), found with running sums over the sources by most * size / weight. One row a source
    passes through one task.
    """
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") - 1) % n + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * most)
    every = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / share).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    level = F.coalesce(F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))).over(every), F.max("level").over(every))
    return levelled.select("source", "source_size", F.least("cap", level * F.col("weight")).alias("target"))


class Mix:
    """What a mix takes: for each source its size, target, whole rounds and the limit of the last round's hashes."""

    def __init__(self, sources: DataFrame, few: bool):
        self.sources, self.few = sources, few

    def join(self, rows: DataFrame, other: DataFrame | None = None) -> DataFrame:
        """``rows`` with their source's columns, by a broadcast only if the sources are few."""
        other = (self.sources if other is None else other).withColumnRenamed("source", "_source")
        other = F.broadcast(other) if self.few else other
        return rows.join(other, rows.source.eqNullSafe(other._source), "left").drop("_source")


#: How often a document is taken, by its hash ``h`` and its source's columns.
COPIES = "whole + CASE WHEN h <= coalesce(`limit`, -1) THEN 1 ELSE 0 END"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, h of every document, checkpointed."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), hash60(F.col(id_col)).alias("h")))


def plan_mix(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, level_bits: int = 12) -> Mix:
    """The mix of ``sized`` (source, size, h).

    A source with target t and size s takes every document floor(t / s) times, and once more those whose hash is at or
    below the limit at which their sizes come nearest to the rest of the target; without a rest none, empty ones included.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = source_targets(sums, weights, most).withColumn("whole", whole)
    sources = cut(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    mix = Mix(sources, sources.count() <= BROADCAST_SOURCES)
    # Of each source: the bucket (a prefix of the hash) in which the budget runs out, and the sum of sizes before it.
    found = sources.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    bits = 0
    for step in (level_bits, level_bits, HASH_BITS - 2 * level_bits):
        inside = mix.join(sized, found).where(F.col("prefix") == F.shiftright("h", HASH_BITS - bits) if bits else F.lit(True))
        bits += step
        sums = inside.groupBy("source", F.shiftright("h", HASH_BITS - bits).alias("prefix")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = F.col("start") + F.sum("n").over(W.partitionBy("source").orderBy("prefix"))
        sums = sums.withColumn("upto", upto).withColumn("before", upto - F.col("n"))
        found = sums.where((F.col("upto") > F.col("rest")) & (F.col("before") <= F.col("rest"))).select("source", "rest", "prefix", "before", "upto")
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
    limits = found.select("source", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("limit"))
    return Mix(mix.join(sources, limits).select("source", "source_size", "target", "whole", "limit"), mix.few)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    sized = sizes(docs, id_col, text_col, source_col)
    copies = F.expr(COPIES)
    out = plan_mix(sized, weights, most).join(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, source and more) as the mix takes them: each row as often as it is taken."""
    mix = plan_mix(sizes(docs), weights, most)
    # Columns go within one, so that no name clashes.
    rows = docs.select("source", hash60(F.col("doc_id")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = mix.join(rows).withColumn("copies", F.expr(COPIES).cast("int")).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM {documents}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 3.0::DOUBLE * source_size AS cap FROM sums),
weighed AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, level.level * weight)::DOUBLE AS target FROM levels, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
steps AS (
  SELECT s.source, s.h, sum(sum(s.size)) OVER (PARTITION BY s.source ORDER BY s.h) AS upto, sum(s.size) AS n,
         p.target - p.whole * p.source_size AS rest
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source, s.h, p.target, p.whole, p.source_size),
limits AS (
  SELECT source, CASE WHEN upto - rest < rest - (upto - n) THEN h ELSE h - 1 END AS lim
  FROM steps WHERE rest > 0 AND upto > rest AND upto - n <= rest)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * (p.whole + CASE WHEN s.h <= coalesce(l.lim, -1) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (p.whole + CASE WHEN s.h <= coalesce(l.lim, -1) THEN 1 ELSE 0 END)::BIGINT AS copies{more}
FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
"""

QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLE = {"op2_mix_sources": MIX_SQL.format(documents="documents", more="")}
