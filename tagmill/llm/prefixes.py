"""Similarity join of word shingles by grouped prefixes.

Shingles (64-bit hashes) stand in one order for all texts: those that occur in many texts come last (up to HOT_SHINGLES of
them, by their counts over all texts), the others by hash. The first n - ceil(percent * n / 100) + 1 of a set's n shingles are its
prefix, and two sets that are similar enough have a shingle of both prefixes. Texts with equal sets are one class; classes
with the same prefix and the same size are one group, and groups are joined instead of sets: by a shingle of both prefixes
and by their size, which lies in one band of sizes or two that follow each other. The prefix that ends first in the order has no further shingle in
common with the other set, so the shingles that two groups share in their prefixes and what is left of that set after its
prefix bound the members' overlap, and so do the places of the last shared one; pairs that can't reach it go. What a pair
of groups leaves is expanded into its members and verified on full sets, which also links the members of one group.

Where more than SMALL groups share a shingle and a band they aren't paired. Their members' whole sets are cut by hash into
one part more than the shingles in which two similar sets of that band can differ, so that two similar sets have an equal
part, and members with an equal part are chained to the smallest. What pairs and chains connect is a family. A family's
members are compared as a whole with counted intersections (``minhash.family_links``), in blocks bounded in shingles and
sets; so no key, however frequent, makes all its pairs, and no link between different texts is lost.

Cases: a text without words (or null) has an empty set and no links; with fewer words than ``width`` the whole sequence
is the one shingle; rows that repeat a doc_id count as one document with all their links, rows with a null doc_id as one
for each distinct set; component_id is the smallest non-null doc_id (null if there is none); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import cut, table
from .minhash import _mix as mix
from .minhash import family_links, shingles, sized, texts_of, with_components

WIDTH, PERCENT = 3, 90
#: Groups that share a shingle and are still joined pair by pair; shingles that more texts hold come last in the order, if
#: they are among the HOT_SHINGLES most frequent (8 bytes each travel to every task).
SMALL, HOT_SHINGLES = 32, 1 << 18
#: Of a set of n shingles n / HEAD_PART + HEAD_LEAST with the least hashes are counted and kept for the prefix. Where too
#: many of them are frequent, the prefix comes from the text again.
HEAD_PART, HEAD_LEAST = 8, 8
#: Up to so many classes or nodes (24 bytes each) are broadcast to pick rows; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def band_of(size: int, percent: int = PERCENT) -> int:
    """Bands are so wide that the sizes of two similar sets lie in one or in two that follow each other."""
    return int(math.log(size) / _wide(percent))


def _wide(percent: int) -> float:
    return math.log(100 / percent) * (1 + 1e-9)


def parts_in(band: int, percent: int = PERCENT) -> int:
    """More parts than the shingles in which two similar sets differ, if the larger one's size lies in ``band``."""
    most = math.ceil(math.exp((band + 1) * _wide(percent))) + 1
    return 2 * (100 - percent) * most // (100 + percent) + 1


def part_keys(s: np.ndarray, band: int, percent: int = PERCENT) -> np.ndarray:
    """A key for each part of a set; empty parts have one too, as the one equal part of two sets may be empty."""
    n = parts_in(band, percent)
    mixed = mix(s * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(n, np.uint64)
    np.add.at(sums, (mixed >> np.uint64(33)).astype(np.int64) % n, mixed)
    return mix((sums ^ np.uint64(band)) * np.uint64(0xD6E8FEB86659FD93) + np.arange(n, dtype=np.uint64)).view(np.int64)


def _facts(width: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, row, text in zip(pdf["doc_id"], pdf["row"], pdf["text"], strict=True):
                s = shingles(text, width)
                some = len(s) > 0
                out.append((i, row, len(s), xxhash.xxh3_128_digest(s.tobytes()) if some else None, s[: len(s) // HEAD_PART + HEAD_LEAST].view(np.int64) if some else None))
            yield pd.DataFrame(out, columns=["doc_id", "row", "n", "fp", "head"]).astype({"doc_id": "Int64"})

    return run


def ordered_prefix(head: np.ndarray, n: int, hot: np.ndarray, percent: int = PERCENT) -> np.ndarray | None:
    """The prefix of a set of n shingles whose least hashes are ``head`` (ascending, unsigned), or None if they don't tell."""
    at = np.minimum(np.searchsorted(hot, head), max(len(hot) - 1, 0))
    late = hot[at] == head if len(hot) else np.zeros(len(head), bool)
    most, first = prefix_length(n, percent), head[~late]
    if len(first) < most and len(head) == n:
        first = np.concatenate([first, head[late]])
    return first[:most] if len(first) >= most else None


def place_of_last(prefix: np.ndarray, hot: np.ndarray) -> int:
    """Where a prefix ends in the order of shingles, to 62 bits."""
    last = prefix[-1]
    late = len(hot) > 0 and hot[min(int(np.searchsorted(hot, last)), len(hot) - 1)] == last
    return (int(late) << 62) | (int(last) >> 2)


_PREFIX = "fp binary, band int, last long, grp binary, prefix array<long>"


def _described(fps: list, sizes: list[int], prefixes: list[np.ndarray | None], hot: np.ndarray, percent: int) -> pd.DataFrame:
    """Rows of _PREFIX; what has one prefix and size has one ``grp``, a hash of 128 bits. Without prefix all is null but fp."""
    rows = []
    for fp, n, f in zip(fps, sizes, prefixes, strict=True):
        rows.append((fp, None, None, None, None) if f is None else (fp, band_of(n, percent), place_of_last(f, hot), xxhash.xxh3_128_digest(f.tobytes(), n), f.view(np.int64)))
    return pd.DataFrame(rows, columns=["fp", "band", "last", "grp", "prefix"]).astype({"band": "Int32", "last": "Int64"})


def _prefixes(hot: np.ndarray, percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sizes = pdf["n"].tolist()
            found = [ordered_prefix(np.asarray(h, np.int64).view(np.uint64), n, hot, percent) for h, n in zip(pdf["head"], sizes, strict=True)]
            yield _described(pdf["fp"].tolist(), sizes, found, hot, percent)

    return run


def _read_prefixes(hot: np.ndarray, width: int, percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            sets = [s for s in (shingles(t, width) for t in pdf["text"]) if len(s)]
            yield _described([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], list(map(len, sets)), [ordered_prefix(s, len(s), hot, percent) for s in sets], hot, percent)

    return run


def _parts(width: int, percent: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for s in (shingles(t, width) for t in pdf["text"]):
                if len(s):
                    band = band_of(len(s), percent)
                    found = [part_keys(s, of, percent) for of in (band, band + 1)]
                    yield pd.DataFrame({"fp": [xxhash.xxh3_128_digest(s.tobytes())] * 2, "of": [band, band + 1], "keys": found})

    return run


def hot_shingles(heads: DataFrame, most: int = HOT_SHINGLES) -> np.ndarray:
    """The shingles of more than SMALL classes in ``heads`` (head), sorted; the ``most`` most frequent, by steps of 2 ** (1 / 8)."""
    counts = cut(heads.select(F.explode("head").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL))
    step = F.floor(8 * F.log2("n")).cast("int")
    levels = sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # a row for each step
    total, least = 0, None
    for s, k in levels:
        if total + k > most:
            break
        total, least = total + k, s
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r.h for r in counts.where(step >= least).select("h").collect()], np.int64).view(np.uint64))


def _group_pairs(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(u, v): edges that connect, among others, every two groups (node, size, band, last, prefix) whose members may be similar
    enough and that share no crowded shingle; and (node, of): the groups that hold a crowded shingle, and the band for it."""
    rows = groups.select("node", F.col("size").cast("int").alias("size"), "band", "last", F.posexplode("prefix").alias("at", "shingle"))
    again = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("shingle")
    shared = cut(rows.join(again, "shingle"))  # most shingles of a prefix stand in no other
    # Keys are hashes: where two keys fall together pairs are only added, and a bound only rises.
    keyed = shared.withColumn("of", F.explode(F.array("band", F.col("band") + 1)))
    filled = sized(keyed.select(F.xxhash64("shingle", "of").alias("key"), "node", "size", "band", "last", "of", "at"))
    few = filled.where(F.col("n") <= SMALL)
    a = few.select("key", "of", F.col("node").alias("u"), F.col("size").alias("nu"), F.col("band").alias("bu"), F.col("last").alias("lu"), F.col("at").alias("iu"))
    b = few.select("key", F.col("node").alias("v"), F.col("size").alias("nv"), F.col("band").alias("bv"), F.col("last").alias("lv"), F.col("at").alias("iv"))
    met = a.join(b, "key").where((F.col("u") < F.col("v")) & (F.col("of") == F.greatest("bu", "bv")))  # pairs of one band have two keys and count under one
    met = met.where((100 * F.col("nu") >= percent * F.col("nv")) & (100 * F.col("nv") >= percent * F.col("nu")))
    # A pair that also shares a crowded shingle is found by its parts, so what is counted here may leave that out.
    both = met.groupBy("u", "v", "nu", "nv", "lu", "lv").agg(F.count(F.lit(1)).alias("both"), F.max("iu").alias("iu"), F.max("iv").alias("iv"))
    left_u, left_v = (F.ceil(percent * F.col(n) / 100) - 1 for n in ("nu", "nv"))
    after = F.when(F.col("lu") < F.col("lv"), left_u).when(F.col("lu") > F.col("lv"), left_v).otherwise(F.greatest(left_u, left_v))
    most = F.col("both") + F.least(F.col("nu") - 1 - F.col("iu"), F.col("nv") - 1 - F.col("iv"), after)
    real = both.where((100 + percent) * most >= percent * (F.col("nu") + F.col("nv"))).select("u", "v")
    return real, cut(filled.where(F.col("n") > SMALL).select("node", "of").distinct())


def _equal_parts(crowded: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): edges that connect, among others, every two similar sets of ``crowded`` (fp, rep, node, of)."""
    ids = cut(crowded.select("rep").distinct())
    found = texts_of(ids, ids.count(), docs).mapInPandas(_parts(width, percent), "fp binary, of int, keys array<long>")
    found = found.join(crowded.select("fp", "of", "node"), ["fp", "of"]).select("node", F.explode("keys").alias("key"))
    alike = sized(found.distinct())
    return alike.where(F.col("node") != F.col("low")).select(F.col("node").alias("u"), F.col("low").alias("v")).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    facts = cut(numbered.mapInPandas(_facts(width), "doc_id long, row long, n long, fp binary, head array<long>"))
    classes = facts.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    nodes = cut(classes.withColumn("node", F.coalesce("rep", F.xxhash64("fp"))))
    # One row of each class; heads stay where they are.
    several = _sent(nodes.where("rows > 1").select("fp", "first"))
    heads = facts.where("n > 0").join(several, "fp", "left").where("first is null or first = row").select("fp", "n", "head")
    hot = hot_shingles(heads)
    told = cut(heads.mapInPandas(_prefixes(hot, percent), _PREFIX))
    lacking, own = told.where("prefix is null").select("fp"), nodes.select("fp", "rep", "node", "n")
    described = told.where("prefix is not null")
    many = lacking.count()
    if many:
        wanted = cut(own.join(lacking, "fp", "left_semi"))
        read = texts_of(wanted.select("rep").distinct(), many, docs).mapInPandas(_read_prefixes(hot, width, percent), _PREFIX)
        described = described.union(cut(read.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])))
    members = cut(own.join(described.select("fp", "grp"), "fp").withColumnRenamed("n", "size"))
    groups = cut(members.groupBy("grp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("grp", "first"))
    inner = cut(members.join(_sent(groups), "grp").where(F.col("node") != F.col("first")).select("fp", F.col("node").alias("u"), F.col("first").alias("v")))
    single = described.join(_sent(inner.select("fp")), "fp", "left_anti")
    named = single.join(own.select("fp", "node", F.col("n").alias("size")), "fp").select("node", "size", "band", "last", "prefix")
    pairs, crowded = _group_pairs(named, percent)
    edges = pairs.union(inner.select("u", "v"))
    if crowded.take(1):
        whose = crowded.join(members.select("node", "grp"), "node").select("grp", "of").distinct()
        edges = edges.union(_equal_parts(cut(members.join(whose, "grp").select("fp", "rep", "node", "of")), docs, width, percent))
    families = components(edges)
    return with_components(facts, nodes, family_links(families, nodes, docs, width, percent)).toDF("doc_id", "n_shingles", "component_id")


def _sent(rows: DataFrame) -> DataFrame:
    """``rows``, marked for a broadcast if they are few."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_NODES else rows


def op11_prefix_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


#: Brute force over the shingle sets: pairs come from an equi-join on shingles.
JOIN_SQL = r"""
WITH RECURSIVE wl AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM wl),
cls AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0) GROUP BY s),
ex AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
prs AS (
  SELECT a.rep AS u, b.rep AS v FROM ex a JOIN ex b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
near AS (SELECT u, v FROM prs UNION ALL SELECT v, u FROM prs),
reach AS (SELECT rep AS node, rep AS r FROM cls UNION SELECT near.v, reach.r FROM reach JOIN near ON near.u = reach.node),
roots AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(roots.component_id, sh.doc_id) AS component_id
FROM sh LEFT JOIN cls ON list_sort(sh.s) = cls.s LEFT JOIN roots ON roots.node = cls.rep"""

QUERIES = {"op11_prefix_join": op11_prefix_join}
ORACLE = {"op11_prefix_join": JOIN_SQL}
