"""Near-duplicates, splits and samples against brute force and invariants."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tagmill.operators import neardup as N
from tagmill.operators import numbering as S
from tagmill.operators import split as P
from tagmill.operators.graph import components
from tagmill.plans import duplicates


def hashes(n=120, seed=3):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(12)]
    out = []
    for i in range(n):
        h = rnd.choice(base)
        for _ in range(rnd.randrange(0, 7)):
            h ^= 1 << rnd.randrange(64)
        out.append((i, h - (1 << 64) if h >> 63 else h))
    return out


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize(("most", "extra"), [(3, 1), (5, 2), (5, 3), (8, 1)])
def test_hamming_pairs_are_exact(spark, most, extra):
    rows = hashes()
    values = sorted({h for _, h in rows})
    want = {(a, b, distance(a, b)) for i, a in enumerate(values) for b in values[i + 1 :] if distance(a, b) <= most}
    found = [tuple(r) for r in N.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), most, extra).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_groups_ignore_null_hashes(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2, None), (3, None), (4, -1)], "id long, h long")
    assert [(r.id, r.dup_group, r.dup_rep) for r in N.duplicate_groups(df, 5).orderBy("id").collect()] == [(0, 0, True), (1, 0, False)]
    assert N.group_stats(N.duplicate_groups(df, 5)).first().asDict() == {"groups": 1, "surplus": 1, "largest": 2}


def test_groups_are_transitive(spark):
    rows = hashes(60, 9)
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows:
            if i < j and distance(a, b) <= 5:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = N.duplicate_groups(spark.createDataFrame(rows, "id long, h long"), 5)
    firsts = {r.dup_group: r.id for r in found.where("dup_rep").collect()}
    assert {r.id: firsts[r.dup_group] for r in found.collect()} == {i: root(i) for i, _ in rows if sum(root(j) == root(i) for j, _ in rows) > 1}
    assert sorted(firsts) == list(range(len(firsts))) and [firsts[k] for k in sorted(firsts)] == sorted(firsts.values())


def test_long_chain_of_components(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components(edges).select("root").distinct().collect()[0].root == 0
    assert components(edges.limit(0)).count() == 0


def test_gradient_hash(spark):
    pixels = list(range(72))
    row = spark.createDataFrame([(pixels, pixels[::-1])], "a array<int>, b array<int>")
    a, b = row.select(N.gradient_hash(F.col("a")), N.gradient_hash(F.col("b"))).first()
    assert (a, b) == (-1, 0)


@pytest.mark.parametrize("order", ["md5", "python"])
def test_split_keeps_groups_and_ratios(spark, order):
    keys = spark.createDataFrame([(f"g{i % 50}",) for i in range(400)], "key string")
    rows = P.assign_splits(keys, (0.7, 0.2, 0.1), 42, order).collect()
    assert len(rows) == 50 and sum(r.n for r in rows) == 400
    share = {s: sum(r.n for r in rows if r.split == s) / 400 for s in P.NAMES}
    assert abs(share["train"] - 0.7) < 0.03 and abs(share["val"] - 0.2) < 0.03
    assert rows and sorted(map(tuple, P.assign_splits(keys, (0.7, 0.2, 0.1), 42, order).collect())) == sorted(map(tuple, rows))


def test_validation_part_is_never_empty(spark):
    keys = spark.createDataFrame([("g0",), ("g0",), ("g1",)], "key string")
    for order in ("md5", "python"):
        assert "val" in {r.split for r in P.assign_splits(keys, (0.9, 0.1, 0.0), 1, order).collect()}


def test_zero_ratios_and_blocks(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(200)], "key string")
    assert {r.split for r in P.assign_splits(keys, (0, 0, 0)).collect()} == {"train"}
    rows = P.assign_splits(keys, (0.5, 0.5, 0), block_groups=20).collect()
    assert len(rows) == 200 and abs(sum(r.split == "val" for r in rows) - 100) <= 10


@pytest.mark.parametrize("order", ["md5", "python"])
def test_split_is_one_pass_at_every_size(spark, order):
    keys = spark.createDataFrame([(f"k{i}", 1 + i * i % 7) for i in range(300)] + [("hot", 600)], "key string, n long")
    whole, sliced = (sorted(map(tuple, P.assign_splits(keys, (0.7, 0.2, 0.1), 42, order, b).collect())) for b in (1000, 20))
    assert sliced == whole and len(whole) == 301
    if order == "md5":
        filled, want = {"train": 0, "val": 0, "test": 0}, []
        rows = sorted(map(tuple, keys.collect()), key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest())
        target = {name: r * sum(n for _, n in rows) for name, r in zip(P.NAMES, (0.7 / sum((0.7, 0.2, 0.1)), 0.2 / sum((0.7, 0.2, 0.1)), 0.1 / sum((0.7, 0.2, 0.1))), strict=True)}
        for key, n in rows:
            pick = max(target, key=lambda name: target[name] - filled[name])
            filled[pick] += n
            want.append((key, n, pick))
        assert sliced == sorted(want)
    assert P.assign_splits(keys.limit(0)).count() == 0


def test_leak_gate():
    assert P.leak_gate(5, 5, 0) == ("continue", "no leak")
    assert P.leak_gate(5, 5, 2)[0] == "ask" and P.leak_gate(0, 5, 2)[0] == "continue"
    assert P.leak_gate(5, 5, 0, error="no file")[0] == "ask" and P.leak_gate(5, 5, 2, cancelled=True)[0] == "stop"


@pytest.mark.parametrize(("n", "most"), [(10, 3), (1000, 400), (7, 7), (5, 9), (97, 96)])
def test_systematic_sample(spark, n, most):
    have = sorted(r.id for r in S.systematic_sample(spark.range(n), most, "id").collect())
    assert have == (list(range(n)) if n <= most else [int(i * (n / most)) for i in range(most)])


def test_order_statistics_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.randrange(1000))) for _ in range(500)] + [("one", 5.0), ("two", 1.0), ("two", 4.0)]
    found = {r.k: (r.n, r.median, r.p95) for r in S.order_statistics(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert found == {"hot": (500, (hot[249] + hot[250]) / 2, hot[int(0.95 * 499)]), "one": (1, 5.0, 5.0), "two": (2, 2.5, 1.0)}


def test_hubs_and_common_labels(spark, monkeypatch):
    """A hub with most edges, and a label that most nodes bear, are dealt over salted keys."""
    from tagmill.operators import graph as G

    monkeypatch.setattr(G, "HOT_LEAST", 5)
    edges = [(0, i) for i in range(1, 80)] + [(100 + i, 101 + i) for i in range(30)] + [(79, 100), (500, 501), (7, 7)]
    found = {r.node: r.root for r in G.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in [*range(80), *range(100, 131)]} | {500: 500, 501: 500}
    rows = spark.createDataFrame([(7, i) for i in range(50)] + [(i, i) for i in range(20)], "k long, x long")
    by = spark.createDataFrame([(i, i * i) for i in range(15)], "k long, y long")
    assert sorted(map(tuple, G.hot_join(rows, by, "k", 70).collect())) == sorted((k, x, k * k) for k, x in [(7, i) for i in range(50)] + [(i, i) for i in range(15)])


def test_wide_distances_compare_few_pairs(spark):
    """Random hashes with planted neighbours: no pair is lost, and a twentieth of all pairs is looked at."""
    rng = random.Random(2)
    hashes = [rng.getrandbits(63) for _ in range(600)]
    hashes += [h ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(1, 18))) for h in hashes[:120]] + hashes[:5]
    df = spark.createDataFrame([(h,) for h in hashes] + [(None,)], "h long")
    want = sorted((a, b, (a ^ b).bit_count()) for a, b in itertools.combinations(sorted(set(hashes)), 2) if (a ^ b).bit_count() <= 15)
    assert sorted(map(tuple, N.hamming_pairs_probed(df, 15, 4, 63).collect())) == want and len(want) > 80
    n = len(set(hashes))
    assert N._near_bands(df, 15, 4, 63).count() < 0.06 * n * (n - 1) / 2
    for most, bands in ((5, 3), (7, 2), (3, 4), (2, 3)):
        got = sorted(map(tuple, N.hamming_pairs_probed(df, most, bands, 63).collect()))
        assert got == [p for p in want if p[2] <= most]


def test_blocks_find_all_pairs_without_rows_for_them(spark, monkeypatch):
    """Negative hashes, blocks of a few hashes, empty blocks: every pair once, and no join makes a row a comparison."""
    rng = random.Random(3)
    found = [rng.getrandbits(64) - 2**63 for _ in range(300)]
    found += [h ^ sum(1 << i for i in rng.sample(range(63), rng.randrange(1, 18))) for h in found[:100]] + found[:5]
    df = spark.createDataFrame([(h,) for h in found] + [(None,)], "h long")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = sorted((a, b, far(a, b)) for a, b in itertools.combinations(sorted(set(found)), 2) if far(a, b) <= 15)
    assert len(want) > 60
    for size, at_once in ((65_536, 65_536), (30, 100), (30, 7)):
        monkeypatch.setattr(N, "BLOCK_HASHES", size)
        monkeypatch.setattr(N, "AT_ONCE", at_once)
        assert sorted(map(tuple, N.hamming_pairs_blocked(df, 15).collect())) == want
    for few in ([], [(5,)], [(5,), (5,), (7,)]):
        assert N.hamming_pairs_blocked(spark.createDataFrame(few, "h long"), 15).count() == (len(set(few)) == 2)
    from tagmill.plans import duplicates as D

    plan = D.hamming_pairs_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_dealt_hashes_are_not_broadcast(spark):
    """What Spark takes for a small table holds a row a hash and key: it must not pass through the driver."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    pairs = N.hamming_pairs(spark.createDataFrame(hashes(), "id long, h long"), 5)
    assert pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def broadcast_joins(spark, run):
    """Keys of the joins by broadcast in all jobs of ``run``, as Spark carried them out, with names instead of numbered columns."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    ids = lambda: {x.executionId() for x in (lambda seq: [seq.apply(i) for i in range(seq.size())])(store.executionsList())}
    old = ids()
    run()
    bus.waitUntilEmpty()
    found = set()
    for k in ids() - old:
        nodes = store.planGraph(k).allNodes()
        said = [nodes.apply(i).desc() for i in range(nodes.size())]
        found |= {re.search(r"\[(.*?)\]", re.sub(r"#\d+L?", "", x))[1] for x in said if x.startswith("BroadcastHashJoin")}
    return found


#: _p: a row a partition; dup_group: the ten largest groups.
ROWS_STAY = {
    "neardup_groups": {"_p"},
    "neardup_keys": {"_p"},
    "neardup_largest": {"_p", "dup_group"},
    "neardup_line": {"_p"},
    "neardup_representatives": {"_p"},
    "neardup_stats": {"_p"},
    "split_assign_md5": {"_p"},
    "split_leak_examples": {"_p"},
    "split_leak_groups": {"_p"},
}


@pytest.mark.parametrize(("query", "bounded"), ROWS_STAY.items())
def test_rows_are_not_broadcast(spark, query, bounded):
    """No hash, label or row of the table passes through the driver, not even while tables are small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert broadcast_joins(spark, lambda: duplicates.QUERIES[query](spark, "/root/testdata/sf0.001").collect()) <= bounded
