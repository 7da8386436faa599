"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct ``width``-word shingles (64-bit hashes). Under each permutation both the minimum
and the maximum are kept, so a signature of 2k values costs k hash evaluations; three values of different permutations
make a band. A pair of similarity 0.75 shares none of 32 bands with a probability of 2e-8.

Documents with equal sets form one class, which acts as a single node from then on. Classes that share a band lie in a
bucket. In a bucket of up to SMALL classes every two of them are a pair, and a pair that shares LEAST bands or more, in
whatever buckets, is a candidate (a pair of similarity 0.75 shares fewer with a probability of 7e-6). The classes of a
larger bucket are dealt again by 57 bands of five values (a pair of similarity 0.75 shares none of them with a probability
of 2e-7); what still is larger than SMALL is chained to its smallest class. Which third class shares a bucket thus never
separates two.

Classes connected by candidates form a family, and families are compared on their full sets with counted intersections
(inverted lists, no matrix). Small families are packed into tasks. A large one is cut into blocks bounded in shingles and
in sets: first each block is compared within itself and with PIVOTS common sets, which joins what belongs to one cluster
of near copies in linear work; then blocks are compared two by two, but for those of one cluster. Only edges of spanning
forests leave a task, never all pairs, and the components are those of all links. A family that stays in many clusters
(long common templates around different texts) costs as many tasks as it has pairs of blocks.

Cases: a text without words (or null) has an empty set and no links; with fewer words than ``width`` the whole sequence
is the one shingle; rows that repeat a doc_id count as one document with all their links, rows with a null doc_id as one
for each distinct set; component_id is the smallest non-null doc_id (null if there is none, and the row is kept if its
set is not a copy of an identified one); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, hot_join
from .common import cut, table

WIDTH, PERCENT, PERMUTATIONS, ROWS, LEAST = 5, 75, 48, 3, 3
#: Classes in a bucket that is compared pair by pair; values in a band that splits a larger one, and how often the
#: signature is dealt into such bands.
SMALL, FINE_ROWS, FINE_DEALS = 16, 5, 3
#: Shingles and sets in a block of a family, on average: what bounds the memory and time of a task that compares two
#: blocks. Small families are packed to PACK shingles, on average.
BLOCK, BLOCK_SETS, PACK, PIVOTS = 1 << 18, 1 << 12, 1 << 15, 4
#: Up to so many ids (8 bytes each) are broadcast to pick the texts to be compared; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240)
_A = (_RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(h.tobytes() + b"short")], np.uint64)
    n, acc = len(h) - width + 1, h[: len(h) - width + 1].copy()
    for k in range(1, width):
        acc = _mix(acc * _BASE + h[k : k + n])
    return np.unique(acc)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 4096):
        v = _A[:, None] * s[None, i : i + 4096] + _B[:, None]
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return np.concatenate([low, high])


def bands(sig: np.ndarray) -> np.ndarray:
    """A key for each band; its values lie a third of the signature apart, so no band holds both ends of a permutation."""
    n = len(sig) // ROWS
    key = np.arange(n, dtype=np.uint64)
    for part in sig.reshape(ROWS, n):
        key = _mix(key * _BASE + part)
    return key.view(np.int64)


def _fine_places() -> np.ndarray:
    """Which values of a signature make each of the bands of FINE_ROWS; every deal takes values at another distance."""
    size = 2 * PERMUTATIONS
    n = size // FINE_ROWS
    return np.concatenate([(np.arange(FINE_ROWS)[:, None] * (n + deal) + np.arange(n)) % size for deal in range(FINE_DEALS)], axis=1)


_FINE = _fine_places()


def fine_bands(sig: np.ndarray) -> np.ndarray:
    """A 32-bit key for each of the bands of FINE_ROWS values."""
    key = np.arange(_FINE.shape[1], dtype=np.uint64)
    for part in sig[_FINE]:
        key = _mix(key * _BASE + part)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _facts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for i, text, mark in zip(pdf["doc_id"], pdf["text"], pdf["mark"], strict=True):
            s = shingles(text)
            some = len(s) > 0
            sig = signature(s) if some else None
            out.append((i, mark, len(s), xxhash.xxh3_128_digest(s.tobytes()) if some else None, bands(sig) if some else None, fine_bands(sig) if some else None))
        yield pd.DataFrame(out, columns=["doc_id", "mark", "n", "fp", "bands", "fine"]).astype({"doc_id": "Int64"})


def sets_of(width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Texts to (fp, shingles)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for text in pdf["text"]:
                s = shingles(text, width)
                out.append((xxhash.xxh3_128_digest(s.tobytes()), s.view(np.int64)))
            yield pd.DataFrame(out, columns=["fp", "shingles"])

    return run


class _Overlaps:
    """Intersection sizes of one set with all sets of a list, from inverted lists of the shingles that several hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        self.columns = np.split(column, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
        self.owners = owner[np.argsort(column, kind="stable")]
        times = np.where(times > 1, times, 0)
        self.ends = np.cumsum(times)
        self.starts = self.ends - times

    def linked(self, u: int, percent: int = PERCENT) -> np.ndarray:
        """The sets that are similar enough to the u-th."""
        starts, ends = self.starts[self.columns[u]], self.ends[self.columns[u]]
        lengths = ends - starts
        at = np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
        common = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes[u] + self.sizes - common))


def _parts(sets: list[np.ndarray], groups: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """A number for each set, equal for those that links connect; sets of one group count as connected from the start.

    A link has two ends, so the largest group's sets need no look of their own, and nothing is left to see once all are
    connected.
    """
    part = np.arange(len(sets)) if groups is None else np.unique(groups, return_inverse=True)[1]
    sizes = np.bincount(part)
    left, overlaps = len(sizes), _Overlaps(sets)
    for u in np.flatnonzero(part != sizes.argmax()) if groups is not None else range(len(sets)):
        if left == 1:
            break
        found = np.unique(part[overlaps.linked(u, percent)])
        found = found[found != part[u]]
        if len(found):
            part[np.isin(part, found)] = part[u]
            left -= len(found)
    return part


def _cell(pdf: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """(u, v): what is connected within a cell, as stars: whole small families, a block of a large one with pivots, or two
    blocks of it. A star's middle is a pivot if it has one, else the smallest node."""
    out = []
    pdf = pdf.sort_values(["node", "pivot"], ascending=[True, False]).drop_duplicates("node")
    for _, family in pdf.groupby("root"):
        nodes, groups = family["node"].to_numpy(np.int64), family["grp"]
        part = _parts([np.asarray(s, np.int64) for s in family["shingles"]], groups.to_numpy(np.int64) if groups.notna().all() else None, percent)
        order = np.lexsort((nodes, ~family["pivot"].to_numpy(bool), part))
        first = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
        middle = np.repeat(nodes[order][first], np.diff(np.r_[first, len(order)]))
        some = nodes[order] != middle
        out.append(pd.DataFrame({"u": nodes[order][some], "v": middle[some]}))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "v": []}, dtype=np.int64)


def sized(rows: DataFrame) -> DataFrame:
    """Rows (key, node and others) of buckets of two or more, with the bucket's size ``n`` and its smallest class ``low``."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    return cut(rows.join(sizes, "key"))  # a hot key's rows are split by adaptive execution


def _candidates(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that connect, among others, every two classes that share enough bands."""
    signed = nodes.select("node", "bands")

    def pairs(rows: DataFrame) -> DataFrame:
        few = rows.where(F.col("n") <= SMALL)
        return few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key").where("u < v").select("u", "v")

    first = sized(nodes.select("node", F.explode("bands").alias("key")))
    wide = first.where(F.col("n") > SMALL).select("node").distinct()
    fine = nodes.join(wide, "node", "left_semi").select("node", F.posexplode("fine").alias("j", "key"))
    second = sized(fine.select("node", F.struct("j", "key").alias("key")))
    real = pairs(first).union(pairs(second)).distinct()
    real = real.join(signed.toDF("u", "bu"), "u").join(signed.toDF("v", "bv"), "v").where(F.size(F.array_intersect("bu", "bv")) >= LEAST)
    chained = second.where((F.col("n") > SMALL) & (F.col("node") != F.col("low"))).select(F.col("node").alias("u"), F.col("low").alias("v"))
    return real.select("u", "v").union(chained)


def _blocks(shingles: Column, sets: Column) -> Column:
    """The number of blocks of a family of so many sets with so many shingles."""
    return F.ceil(F.greatest(shingles / BLOCK, sets / BLOCK_SETS)).cast("int")


def _compare(placed: DataFrame, percent: int) -> DataFrame:
    """(u, v): what is connected in each cell of (cell, root, node, pivot, grp, shingles)."""
    return placed.select("cell", "root", "node", "pivot", "grp", "shingles").groupBy("cell").applyInPandas(lambda pdf: _cell(pdf, percent), "u long, v long")


def _large_links(large: DataFrame, percent: int) -> DataFrame:
    """What is connected within families of several blocks: (root, node, n, blocks, shingles)."""
    own = large.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("pivot", F.lit(False))
    lowest = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"] for k in range(PIVOTS)]
    pivots = cut(large.groupBy("root").agg(F.array_distinct(F.array(*lowest)).alias("of")).select("root", F.explode("of").alias("node")))
    everywhere = large.join(pivots, ["root", "node"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("pivot", F.lit(True))
    placed = own.unionByName(everywhere).withColumn("cell", F.concat_ws(":", "root", "block")).withColumn("grp", F.lit(None).cast("long"))
    links = cut(_compare(placed, percent))

    # A pivot's cluster is a group; all others are loose sets. Groups and loose sets have blocks of their own.
    middles = links.join(pivots.select(F.col("node").alias("v")), "v", "left_semi").groupBy(F.col("u").alias("node")).agg(F.min("v").alias("middle"))
    middles = middles.union(pivots.join(middles, "node", "left_anti").select("node", "node"))
    grouped = cut(large.join(middles, "node", "left").select("root", "node", "n", "middle", "shingles"))
    grouped = grouped.withColumn("whose", F.coalesce(F.col("middle").cast("string"), F.lit("loose")))
    sizes = grouped.groupBy("root", "whose").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("own"))
    labelled = grouped.join(sizes, ["root", "whose"]).withColumn("label", F.concat_ws(":", "whose", F.pmod(F.xxhash64("node"), F.col("own"))))
    a = cut(labelled.select("root", "label", "middle").distinct())
    b = a.toDF("root", "other", "middle_b")
    met = a.join(b, "root").where((F.col("label") <= F.col("other")) & ~F.coalesce(F.col("middle") == F.col("middle_b"), F.lit(False)))
    met = met.withColumn("cell", F.concat_ws("|", "root", "label", "other"))
    sides = met.select("root", F.explode(F.array_distinct(F.array("label", "other"))).alias("label"), "cell")
    placed = labelled.join(sides, ["root", "label"]).withColumn("grp", F.coalesce("middle", "node")).withColumn("pivot", F.lit(False))
    return links.union(_compare(placed, percent))


def texts_of(ids: DataFrame, many: int, docs: DataFrame) -> DataFrame:
    """The texts of the ``many`` documents ``ids`` (rep): ids travel to the texts as long as they are few enough."""
    if many <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")


def family_links(families: DataFrame, nodes: DataFrame, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(u, v): edges that connect what is linked within each family (node, root)."""
    found = nodes.select("node", "fp", "rep", "n").join(families, "node")
    totals = found.groupBy("root").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("blocks"))
    wanted = cut(found.join(totals, "root"))
    many, total = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("blocks") == 1, F.col("n"))), F.lit(0))).first()
    texts = texts_of(wanted.select("rep").distinct(), many, docs)
    sets = cut(texts.mapInPandas(sets_of(width), "fp binary, shingles array<long>").join(wanted, "fp").dropDuplicates(["fp"]))
    large = sets.where("blocks > 1").select("root", "node", "n", "blocks", "shingles")
    packed = sets.where("blocks = 1").withColumn("cell", F.pmod(F.xxhash64("root"), F.lit(1 + total // PACK)).cast("string"))
    links = _compare(packed.withColumn("grp", F.lit(None).cast("long")).withColumn("pivot", F.lit(False)), percent)
    return links if large.isEmpty() else links.union(_large_links(large, percent))


def with_components(facts: DataFrame, nodes: DataFrame, links: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, component and ``extra`` of every row of ``facts`` (doc_id, n, fp), by the ``links`` between classes ``nodes`` (node, fp, rep)."""
    labels = components(links)
    named = nodes.select("fp", "node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("root", "node"))
    if nodes.where("rep is null").take(1):  # else a class's node is its smallest doc_id, and a component's root too
        roots = cut(named)
        firsts = roots.groupBy("component").agg(F.min("rep").alias("first"))
        named = hot_join(roots, firsts, "component", roots.count()).withColumn("component", F.col("first"))
    named = cut(named.select("fp", "component"))
    full = facts.where("n > 0").select("doc_id", "n", "fp", *extra)
    out = hot_join(full, named, "fp", full.count()).select("doc_id", "n", "component", *extra)
    return out.union(facts.where("n = 0").select("doc_id", "n", "doc_id", *extra))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marked: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; ``marked`` adds ``mark``, xxhash64 of its text, which tells
    rows without id, or of one id, apart."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    facts = cut(docs.withColumn("mark", F.xxhash64("text")).mapInPandas(_facts, "doc_id long, mark long, n long, fp binary, bands array<long>, fine array<int>"))
    classes = facts.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fine").alias("fine"))
    nodes = cut(classes.withColumn("node", F.coalesce("rep", F.xxhash64("fp"))))
    extra = ("mark",) if marked else ()
    out = with_components(facts, nodes, family_links(components(_candidates(nodes)), nodes, docs), extra)
    kept = F.when(F.col("component").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), *extra)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Brute force over the shingle sets: pairs come from an equi-join on shingles.
NEAR_SQL = r"""
wl AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {documents}),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM wl),
cls AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0) GROUP BY s),
ex AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM cls),
prs AS (
  SELECT a.rep AS u, b.rep AS v FROM ex a JOIN ex b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
near AS (SELECT u, v FROM prs UNION ALL SELECT v, u FROM prs),
reach AS (SELECT rep AS node, rep AS r FROM cls UNION SELECT near.v, reach.r FROM reach JOIN near ON near.u = reach.node),
roots AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node),
named AS (SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(roots.component_id, sh.doc_id) AS component_id
  FROM sh LEFT JOIN cls ON list_sort(sh.s) = cls.s LEFT JOIN roots ON roots.node = cls.rep)"""

QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLE = {"op4_near_duplicates": "WITH RECURSIVE " + NEAR_SQL.format(documents="documents") + "\nSELECT *, doc_id = component_id AS kept FROM named"}
