"""The grouped prefix join against all pairs, with crowded shingles, large groups and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tagmill.llm import minhash, prefixes

from .test_documents import docs, words


def brute(rows, width=3, percent=90):
    sets = {}
    for i, t in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in prefixes.similar_documents(df).collect()}


def family_rows():
    """Copies of ten texts with up to three changed words or a few words more, among others that share passages with them."""
    rnd, rows, common = random.Random(3), [], words(30, 500)
    for g in range(10):
        base = words(90, g) + (common if g % 2 else [])
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = "changed" + str(rnd.randrange(5))
            rows.append((len(rows) * 7 % 121, " ".join(w + words(rnd.randrange(0, 9), rnd.randrange(3)))))
    return rows + [(300, None), (301, ""), (302, "One two"), (303, "one TWO"), (304, "one"), (305, " ".join(words(4000, 77))), (306, " ".join(words(4000, 77)[:3700])), (307, " \n ")]


@pytest.mark.parametrize("small, hot, block", [(32, 1 << 18, 1 << 12), (2, 1 << 18, 1 << 12), (2, 0, 10), (4, 100, 7)])
def test_against_all_pairs(spark, monkeypatch, small, hot, block):
    monkeypatch.setattr(prefixes, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    monkeypatch.setattr(prefixes.hot_shingles, "__defaults__", (hot,))
    rows = family_rows()
    want = brute(rows)
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 20
    df = docs(spark, [(i, t, "s") for i, t in rows])
    assert found(df) == want
    assert found(df.repartition(5)) == want


def test_sizes_at_the_border(spark):
    """Sets of 9 and 10, 18 and 20, 90 and 100, 89 and 100 shingles, one within the other."""
    rows, k = [], 0
    for small, large in ((9, 10), (8, 9), (18, 20), (17, 20), (90, 100), (89, 100), (900, 1000), (899, 1000)):
        w = words(large + 2, 40 + k)
        rows += [(k, " ".join(w)), (k + 1, " ".join(w[: small + 2]))]
        k += 2
    got = found(docs(spark, [(i, t, "s") for i, t in rows]))
    assert got == brute(rows)
    assert [got[i + 1][1] == i for i in range(0, k, 2)] == [True, False] * 4


def test_frequent_shingles_only(spark, monkeypatch):
    """Texts made of passages that all others hold too: their prefixes come from the text, not from the least hashes."""
    monkeypatch.setattr(prefixes, "SMALL", 3)
    pool, rnd = [words(25, k) for k in range(8)], random.Random(1)
    rows = [(i, " ".join(w for k in rnd.sample(range(8), 5) for w in pool[k])) for i in range(60)]
    rows += [(100 + i, f"{t} end{i}") for i, t in rows[:20]]
    heads = spark.createDataFrame([(minhash.shingles(t, 3)[:40].view(np.int64).tolist(),) for _, t in rows], "head array<long>")
    assert len(prefixes.hot_shingles(heads)) > 50
    assert found(docs(spark, [(i, t, "s") for i, t in rows])) == brute(rows)


def test_many_texts_with_one_prefix(spark, monkeypatch):
    """A group whose members differ only after the prefix, and the pairs that the join makes of 400 near copies."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 64)
    base, rnd, rows = words(60, 8), random.Random(2), []
    for i in range(400):
        w = list(base)
        w[rnd.randrange(60)] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = docs(spark, [(i, t, "s") for i, t in rows])
    assert found(df) == brute(rows)
    sets = spark.createDataFrame([(i, 58, prefixes.band_of(58), 1000 + i, sorted([*range(8), 1000 + i])) for i in range(400)], "node long, size int, band int, last long, prefix array<long>")
    pairs, crowded = prefixes._group_pairs(sets, 90)
    assert pairs.count() == 0 and crowded.count() == 800  # a crowded shingle costs a row a group and band


def test_a_shingle_in_common_is_not_enough(spark):
    """Of two sets with one shingle of their prefixes in common the first one's end bounds the overlap."""
    rows = [(i, 100, prefixes.band_of(100), 1000 * i + 9, [1, *range(1000 * i, 1000 * i + 10)]) for i in (1, 2, 3)]
    rows += [(9, 100, prefixes.band_of(100), 3020, [1, *range(3000, 3008), 3015, 3020])]
    pairs, _ = prefixes._group_pairs(spark.createDataFrame(rows, "node long, size int, band int, last long, prefix array<long>"), 90)
    assert [tuple(r) for r in pairs.collect()] == [(3, 9)]


def test_similar_sets_have_an_equal_part():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(10, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.r_[rng.permutation(a)[int(rng.integers(0, 1 + n // 20)) :], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 20))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            low, high = sorted((prefixes.band_of(len(a)), prefixes.band_of(len(b))))
            assert high - low <= 1 and prefixes.parts_in(high) > len(a) + len(b) - 2 * both
            assert (prefixes.part_keys(a, high) == prefixes.part_keys(b, high)).any()


def test_prefix_filter_loses_no_pair():
    """Every two similar sets share a shingle of their prefixes, whatever is frequent."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(10, 120))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(rng.integers(0, max(1, len(a) // 10)))
        b = np.sort(rng.permutation(a)[drop:])
        hot = np.sort(rng.permutation(a)[: len(a) // 2])
        x, y = prefixes.ordered_prefix(a, len(a), hot), prefixes.ordered_prefix(b, len(b), hot)
        assert 100 * len(b) < 90 * len(a) or len(np.intersect1d(x, y)) > 0
        part = prefixes.ordered_prefix(a[: len(a) // 4 + 8], len(a), hot)
        assert part is None or part.tolist() == x.tolist()


def test_rows_without_id_repeats_and_nothing(spark):
    df = docs(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, "s"), (None, " ", "s"), (None, "x y z", "s")])
    rows = prefixes.similar_documents(df).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in rows) == sorted([("1", 4, "1"), ("1", 4, "1"), ("None", 4, "1"), ("None", 0, "None"), ("None", 0, "None"), ("None", 1, "None")])
    assert prefixes.similar_documents(df.limit(0)).count() == 0
