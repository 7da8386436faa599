"""Whitening against exact fractions and a plain decomposition, on odd tables too."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "y") for i, e in rows], SCHEMA)


def brute(vectors, k=4):
    """n, deviation by vector, eigenvalues, components and explained shares, by plain loops over fractions."""
    xs = sorted({tuple(math.floor(256 * c) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    mean = [Fraction(sum(x[i] for x in xs), n) for i in range(d)]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n) for j in range(d)] for i in range(d)])
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    deviation = {x: int(sum((n * x[i] - n * mean[i]) ** 2 for i in range(d))) for x in xs}
    white = {x: np.array([float(x[i] - mean[i]) for i in range(d)]) @ parts / np.sqrt(values) for x in xs}
    return n, deviation, white, values / np.trace(cov)


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1] + [50, -3, 0, 0, 1, 0]).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[0]) for i in range(1000, 1200)]  # one vector on 201 rows
    rows += [(None, vectors[1]), (1, vectors[2]), (900, None), (901, []), (902, [None] + vectors[0][1:]), (903, [math.nan] * 6), (904, [math.inf] * 6), (905, [1.0])]
    found = whitening.whiten(frame(spark, rows)).collect()
    n, deviation, white, share = brute(vectors)
    real = [(i, v) for i, v in rows if v and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    assert len(found) == 4 * len(real)
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((str(i), k) for i, _ in real for k in (1, 2, 3, 4))
    by_deviation = {}
    for x, v in deviation.items():
        by_deviation.setdefault(v, x)
    signs = np.zeros(4)
    for r in found:
        want = white[by_deviation[int(r.deviation)]][r.component - 1]
        signs[r.component - 1] = signs[r.component - 1] or math.copysign(1, want * r.whitened)
        assert r.n == n and r.whitened * signs[r.component - 1] == pytest.approx(want, rel=1e-8, abs=1e-8)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("size", [3, 1 << 19, 1 << 30, whitening.HELD])
def test_products_are_exact(size):
    rng = np.random.default_rng(1)
    y = rng.integers(-size, size, (5000, 3), endpoint=True)
    y[0], y[1] = size, -size
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.cross_products(y).tolist() == want


def test_scatter_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, (400, 3))
    x[0, 0] = whitening.HELD
    fit = spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>").repartition(7)
    found = whitening.scatter(fit, 3)
    n = len(x)
    want = [[n * sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) - sum(map(int, x[:, i])) * sum(map(int, x[:, j])) for j in range(3)] for i in range(3)]
    assert found.n == n and found.matrix().tolist() == want


def test_few_dimensions_no_variance_and_nothing(spark):
    flat = whitening.whiten(frame(spark, [(i, [float(i), 2.0]) for i in range(5)])).collect()
    assert sorted((r.component, r.whitened is None, r.explained) for r in flat if r.vec_id == 0) == [(1, False, 1.0), (2, True, 0.0)]
    one = whitening.whiten(frame(spark, [(1, [1e300, -1e300]), (2, [1e300, -1e300])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, None, 0.0)] * 4
    far = whitening.whiten(frame(spark, [(1, [1e300]), (2, [-1e300])])).collect()
    assert {abs(r.whitened) for r in far} == {1.0} and {int(r.deviation) for r in far} == {(2 * whitening.HELD) ** 2}
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0


def test_query(spark):
    out = whitening.op13_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, _, share = brute([[float(np.float64(c)) for c in r.embedding] for r in rows])
    got = out.where(F.col("component") == 1).collect()
    own = {r.vec_id: tuple(math.floor(256 * float(c)) for c in r.embedding) for r in rows}
    assert len(got) == len(rows) and all(r.n == n and r.deviation == deviation[own[r.vec_id]] for r in got)
    assert got[0].identity_error < 1e-4 and got[0].explained == pytest.approx(share[0], rel=1e-6)
