"""Exact and approximate search against brute force, on odd tables too."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import collision, grid, vafile

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute_inner(rows, k, every):
    v = {i: np.floor(256 * np.array(e, float)) for i, e in rows}
    return {q: sorted(((i, int(v[q] @ v[i])) for i in v if i != q), key=lambda x: (-x[1], x[0]))[:k] for q in v if q % every == 0}


def clean(rows):
    return [(i, e) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]


@pytest.fixture
def odd(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(150)]
    rows[7] = (7, rows[3][1])  # the same vector twice
    rows += [(200, None), (201, [None] + [0.5] * 7), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [0.0] * 8), (None, [1.0] * 8)]
    path = str(tmp_path)
    spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def test_exact_topk(spark, odd):
    path, rows = odd
    found: dict = {}
    for r in vafile.op1_vafile_topk(spark, path).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_inner(clean(rows), 5, 50)
    assert {q: [x[1:] for x in sorted(f)] for q, f in found.items()} == want


def test_small_blocks_give_the_same(spark, odd, monkeypatch):
    path, _ = odd
    whole = sorted(map(tuple, vafile.op1_vafile_topk(spark, path).collect()))
    monkeypatch.setattr(grid, "VECTOR_BLOCK", 40)
    monkeypatch.setattr(grid, "QUERY_SPLIT", 1)
    assert sorted(map(tuple, vafile.op1_vafile_topk(spark, path).collect())) == whole


def test_few_candidates_and_empty_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in vafile.exact_topk(few, few.where("id = 0"), 5).collect()] == [(0, 1, 1, 4)]
    assert [tuple(r) for r in collision.nearest(few, few.where("id = 0"), 5).collect()] == [(0, 1, 1, math.sqrt(2))]
    assert vafile.exact_topk(few.limit(0), few, 5).count() == 0 and collision.nearest(few, few.limit(0), 5).count() == 0


def test_recall_and_scores_of_the_collision_search(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found: dict = {}
    for r in collision.op9_collision_ann(spark, SF).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = n = 0
    by_id = dict(rows)
    for q, have in found.items():
        dist = {i: float(np.sqrt(((v - by_id[q]) ** 2).sum())) for i, v in rows if i != q}
        want = sorted(dist, key=lambda i: (dist[i], i))[:10]
        hits += len(set(want) & set(have))
        n += len(want)
        assert all(have[i] == pytest.approx(dist[i], abs=1e-12) for i in have) and len(have) == 10
    assert set(found) == {i for i in by_id if i % 100 == 0} and hits / n >= 0.9


def test_collision_search_leaves_out_odd_vectors(spark, odd):
    path, rows = odd
    found = collision.op9_collision_ann(spark, path)
    good = {i for i, e in clean(rows) if any(e)}
    assert {r.vec_id for r in found.collect()} <= good and {r.query_id for r in found.collect()} == {i for i in good if i % 100 == 0}
    assert found.where("rank = 1 and query_id = vec_id").count() == 0
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(0, [1.0], "a", 3), (1, [2.0], "b", 4)], "id long, v array<double>, query_id string, rank int")
    assert vafile.exact_topk(df.select("id", "v"), df.where(F.col("id") == 0).select("id", "v"), 1).count() == 1


def shapes(n=20_000, d=64):
    rng = np.random.default_rng(11)
    middles = rng.standard_normal((100, d))
    few = rng.standard_normal((n // 20, d))
    return {
        "clusters": middles[rng.integers(0, 100, n)] + 0.3 * rng.standard_normal((n, d)),
        "uniform": rng.random((n, d)),
        "repeats": few[rng.integers(0, len(few), n)],
    }


@pytest.mark.parametrize(("shape", "share"), [("clusters", 0.02), ("uniform", 0.2), ("repeats", 0.25)])
def test_recall_and_share_verified(shape, share):
    """Over three blocks each: at least nine of ten true neighbours, while few vectors are verified."""
    x = shapes()[shape]
    ids, k, hits, wanted, queries = np.arange(len(x)), 10, 0, 0, np.arange(0, len(x), 800)
    blocks = [collision.Block(collision.sorted_projections(ids[j::3], x[j::3])) for j in range(3)]
    for q in queries:
        found = sorted((s, v) for b in blocks for _, v, s in b.nearest(q, x[q], k))[:k]
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        want = np.lexsort((ids, dist))[:k]
        assert all(s == pytest.approx(dist[v], abs=1e-12) for s, v in found)
        hits += sum(s <= dist[want[-1]] + 1e-12 for s, _ in found)
        wanted += k
    assert hits / wanted >= 0.9 and sum(b.verified for b in blocks) / (len(queries) * len(x)) <= share


def test_collision_search_in_several_blocks(spark, monkeypatch):
    """Several blocks and splits of queries find what one block of all vectors may find, ties by id included."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)).round(1)
    x[300:310] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "id long, v array<double>")
    monkeypatch.setattr(grid, "VECTOR_BLOCK", 150)
    monkeypatch.setattr(grid, "QUERY_SPLIT", 3)
    rows = collision.nearest(df, df.where("id % 20 = 0").distinct(), 5).orderBy("query_id", "rank").collect()
    found = {q: [(r.rank, r.vec_id) for r in rows if r.query_id == q] for q in range(0, 600, 20)}
    assert found[0] == [(i + 1, 300 + i) for i in range(5)]
    hits = 0
    for q in found:
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        hits += len({v for _, v in found[q]} & set(np.lexsort((np.arange(600), dist))[:5].tolist()))
    assert hits >= 0.9 * 150


def test_few_vectors_are_read_exactly(spark):
    """The approximation file leaves a few exact reads a query, over two blocks, and its bounds hold."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((3000, 32)))
    parts = [vafile.approximate(np.arange(j, 3000, 2), x[j::2]) for j in range(2)]
    near, slack = vafile.bounds(np.frombuffer(parts[0][1]), np.frombuffer(parts[0][2]), np.frombuffer(parts[0][3], np.uint8).reshape(1500, 32), x[:50])
    assert (np.abs(near - x[:50] @ x[0::2].T) <= slack[:, None]).all()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    left = vafile.candidates(df, df.where("id % 50 = 0"), 5)
    assert left.count() <= 12 * 60
    assert sum(map(len, parts[0])) < 1500 * (32 + 8) + 1000


def test_scores_beyond_doubles_are_exact(spark):
    big = [[3e15, 1.0, -1.0], [2e15, 1.0, 5.0], [2e15, 1.0, 4.0], [1e30, 0.0, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "id long, v array<double>")
    rows = vafile.exact_topk(df, df.where("id = 0"), 3).collect()
    assert [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(i, (1 << 63) - 1) for i in (1, 2, 3)]
