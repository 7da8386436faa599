"""Near-duplicates by the Hamming distance of 64-bit hashes: exact, without comparing all pairs.

A hash is cut into t + e bands. Two hashes at a distance of t or less agree on e bands at least, so they meet under the
key of some e bands; among these keys the pair counts under the first one only, and no pair is made twice. More bands
(larger e) make longer keys and smaller groups for more rows. Rows of equal hashes are one node throughout.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window as W

from ..session import cut
from .graph import components
from .numbering import numbered

SIMHASH_BITS = 60
#: Hashes of a block of ``hamming_pairs_blocked`` (half a MB), and blocks at least, so that few hashes keep many tasks busy.
BLOCK_HASHES, LEAST_BLOCKS = 65_536, 8
#: Distances that a task holds at a time.
AT_ONCE = 65_536


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """60 bits of a text: bit i is set if more than half of its distinct words have it set in their MD5. Null stays null."""
    known: dict[str, bytes] = {}
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        words = set(text.lower().split(" "))
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = hashlib.md5(w.encode()).digest()[:8]
        bits = np.unpackbits(np.frombuffer(b"".join([known[w] for w in words]), np.uint8).reshape(len(words), 8), axis=1)
        set_ = 2 * bits[:, :SIMHASH_BITS].sum(axis=0, dtype=np.int64) > len(words)
        out.append(int.from_bytes(np.packbits(set_).tobytes(), "big") >> (64 - SIMHASH_BITS))
    return pd.Series(out, dtype="Int64")


def diffhash(values: Column) -> Column:
    """Bit i tells whether element i + 1 is larger than element i (up to 64 elements)."""
    steps = F.sequence(F.lit(0), F.size(values) - 2)
    bit = lambda i: F.when(F.get(values, i + 1) > F.get(values, i), 1).otherwise(0).cast("long")
    return F.when(F.size(values) > 1, F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: (acc * 2) + bit(i)))


def gradient_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """The difference hash of a grey image already scaled to 9 x 8, row by row: whether each pixel is brighter than its left one."""
    places = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])
    bit = lambda i: F.when(F.get(pixels, i + 1) > F.get(pixels, i), 1).otherwise(0).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _band(h: Column, k: int, bands: int, bits: int) -> Column:
    low, high = k * bits // bands, (k + 1) * bits // bands
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def hamming_pairs(hashes: DataFrame, most: int, extra: int = 2, bits: int = 64) -> DataFrame:
    """a, b (a < b as signed numbers) and distance of all different hashes at a distance of ``most`` or less. Input: h."""
    nodes = hashes.where("h IS NOT NULL").select("h").distinct()
    bands = most + extra
    # The keys' bands as one literal: there may be many, and code generated for each would be too long to compile.
    keys = F.from_json(F.lit(json.dumps(list(combinations(range(bands), extra)))), "array<array<int>>")
    cut_up = nodes.select("h", F.array(*[_band(F.col("h"), k, bands, bits) for k in range(bands)]).alias("of"))
    dealt = cut_up.select("h", F.posexplode(F.transform(keys, lambda ks: F.xxhash64(F.transform(ks, lambda k: F.get("of", k))))).alias("key", "v"))
    # Spark estimates what is dealt as no more rows than there are hashes, and would broadcast it through the driver.
    met = dealt.withColumnRenamed("h", "a").hint("merge").join(dealt.withColumnRenamed("h", "b"), ["key", "v"])
    a, b = F.col("a"), F.col("b")
    met = met.where((a < b) & (hamming(a, b) <= most))
    agree = F.filter(F.array(*[F.when(_band(a, k, bands, bits) == _band(b, k, bands, bits), k) for k in range(bands)]), lambda x: x.isNotNull())
    own = F.get(keys, F.col("key"))
    return met.where(F.slice(agree, 1, extra) == own).select("a", "b", hamming(a, b).alias("distance"))


def radii(most: int, bands: int) -> list[int]:
    """Distances of which two hashes at a distance of ``most`` or less keep one at least, a band each (they sum up to most - bands + 1)."""
    low, rest = divmod(most - bands + 1, bands)
    return [low + (k < rest) for k in range(bands)]


def _near_bands(hashes: DataFrame, most: int, bands: int, bits: int) -> DataFrame:
    """band, a, b (a < b): hashes whose ``band`` differs by no more than its radius. What is compared in full."""
    nodes = cut(hashes.where("h IS NOT NULL").select("h").distinct())
    width = [(k + 1) * bits // bands - k * bits // bands for k in range(bands)]
    flips = [[sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width[k]), r)] for k, radius in enumerate(radii(most, bands))]
    flips_ = F.from_json(F.lit(json.dumps(flips)), "array<array<bigint>>")
    of = F.array(*[_band(F.col("h"), k, bands, bits) for k in range(bands)])
    index = nodes.select(F.col("h").alias("b"), F.posexplode(of).alias("band", "v"))
    asked = nodes.select(F.col("h").alias("a"), F.posexplode(of).alias("band", "w"))
    asked = asked.select("a", "band", F.explode(F.transform(F.get(flips_, F.col("band")), lambda x: x.bitwiseXOR(F.col("w")))).alias("v"))
    return asked.join(index, ["band", "v"]).where("a < b").select("band", "a", "b")


def hamming_pairs_probed(hashes: DataFrame, most: int, bands: int = 4, bits: int = 64) -> DataFrame:
    """a, b, distance as ``hamming_pairs``, for distances too wide for it.

    Of two hashes at a distance of ``most`` or less one band lies within its radius. A hash is looked up under each value
    within the radius of each of its bands; a pair counts under the first such band. Of random hashes of 63 bits at up to 15
    four bands compare 5 % of all pairs, for 2,788 look-ups a hash; ``hamming_pairs_blocked`` is faster there.
    """
    a, b = F.col("a"), F.col("b")
    near = F.array(*[F.bit_count(_band(a.bitwiseXOR(b), k, bands, bits)) <= r for k, r in enumerate(radii(most, bands))])
    met = _near_bands(hashes, most, bands, bits).where(hamming(a, b) <= most)
    return met.where(F.array_position(near, F.lit(True)) == F.col("band") + 1).select("a", "b", hamming(a, b).alias("distance"))


def _near(sides: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, or within one, some rows of the first at a time."""
    x, y = sides[0], sides[-1]
    rows = max(1, AT_ONCE // len(y))
    shape = min(rows, len(x)), len(y)
    bits, counts, hits = np.empty(shape, np.int64), np.empty(shape, np.uint8), np.empty(shape, bool)  # kept: new ones cost more than the work
    for k in range(0, len(x), rows):
        m = min(rows, len(x) - k)
        np.bitwise_xor(x[k : k + m, None], y[None, :], out=bits[:m])
        apart = np.bitwise_count(bits[:m].view(np.uint64), out=counts[:m])
        i, j = np.divmod(np.flatnonzero(np.less_equal(apart, most, out=hits[:m])), len(y))
        if len(i):
            a, b, d = x[k + i], y[j], apart[i, j]
            own = a < b if len(sides) == 1 else slice(None)  # a block with itself holds each pair twice, and each hash with itself
            yield pa.RecordBatch.from_arrays([np.minimum(a, b)[own], np.maximum(a, b)[own], d[own].astype(np.int32)], ["a", "b", "distance"])


def hamming_pairs_blocked(hashes: DataFrame, most: int) -> DataFrame:
    """a, b, distance as ``hamming_pairs``, at any distance: all pairs are compared, in numpy.

    Different hashes are dealt to blocks of about BLOCK_HASHES; a unit of work is a pair of blocks (or a block with
    itself) and lies in a partition of its own. A task holds two blocks and the distances of some rows. A comparison
    takes some 2 ns, a row that a join makes a hundred times as long, so bands pay only if they spare 99 % of all pairs.
    """
    nodes = cut(hashes.where("h IS NOT NULL").select("h").distinct())
    n = max(LEAST_BLOCKS, -(-nodes.count() // BLOCK_HASHES))
    blocks = nodes.groupBy(F.pmod(F.xxhash64("h"), F.lit(n)).alias("block")).agg(F.collect_list("h").alias("hs"))
    # Unit i * n + j for blocks i <= j: a block goes to each unit it is part of.
    of = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.least("block", k) * n + F.greatest("block", k))
    dealt = blocks.select(F.explode(of).alias("unit"), "hs").repartitionByRange(n * (n + 1) // 2, "unit")
    units = dealt.groupBy("unit").agg(F.collect_list("hs").alias("sides")).where(F.size("sides") + F.when(F.expr(f"unit DIV {n} = unit % {n}"), 1).otherwise(0) == 2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sides in batch.column("sides"):
                yield from _near([x.values.to_numpy() for x in sides], most)

    return units.select("sides").mapInArrow(compare, "a long, b long, distance int")


def duplicate_groups(hashes: DataFrame, most: int, extra: int = 2, bits: int = 64) -> DataFrame:
    """id, dup_group, dup_rep of the rows (id, h) that have a near-duplicate, directly or over others.

    Groups are numbered by their smallest id, which is their representative. Rows without hash belong to none.
    """
    links = hamming_pairs(hashes, most, extra, bits)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), merge=True)
    # Neither roots nor rows go through the driver: Spark would broadcast up to its threshold of them, whichever is smaller.
    rows = hashes.where("h IS NOT NULL").join(roots.withColumnRenamed("node", "h").hint("merge"), "h", "left").select("id", F.coalesce("root", "h").alias("root"))
    groups = rows.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = numbered(groups.select("root", "first"), "first", name="dup_group")
    return rows.join(ordered.hint("merge"), "root").select("id", "dup_group", (F.col("id") == F.col("first")).alias("dup_rep"))


def group_stats(groups: DataFrame) -> DataFrame:
    """One row: groups, surplus (rows beyond each group's first) and the largest group's size."""
    sizes = groups.groupBy("dup_group").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def largest_groups(groups: DataFrame, n: int = 10, names: int = 4) -> DataFrame:
    """dup_group, size and the first ``names`` ids of the ``n`` largest groups."""
    sizes = groups.groupBy("dup_group").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.orderBy(F.col("size").desc(), "dup_group").limit(n)
    w = F.row_number().over(W.partitionBy("dup_group").orderBy("id"))
    some = groups.join(top, "dup_group").withColumn("k", w).where(F.col("k") <= names)
    return some.groupBy("dup_group", "size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


def group_line(keys: DataFrame, key: str = "key") -> DataFrame:
    """One row, ``line``: how many rows there are, in how many groups, and the largest group's size; nulls are one group."""
    sizes = keys.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("most"))
    line = F.format_string("%d images, %d groups (largest %d)", "rows", "groups", "most")
    return facts.select(F.when(F.col("rows") == 0, "0 images").otherwise(line).alias("line"))


def split_keys(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (id and more) with key: dup<group> for near-duplicates, tek<id> for others."""
    # The prefixes of both kinds of keys.
    alone = F.concat(F.lit("tek"), F.col("id").cast("string"))
    out = rows.join(groups.select("id", "dup_group").hint("merge"), "id", "left")  # there may be a row of groups for each of rows
    return out.withColumn("key", F.when(F.col("dup_group").isNull(), alone).otherwise(F.concat(F.lit("dup"), F.col("dup_group").cast("string")))).drop("dup_group")
