"""Non-maximum suppression against a plain loop, in one fold and in rounds."""

from __future__ import annotations

import random

import pytest

from tagmill.operators import suppress

SCHEMA = "image_id string, pr long, cls int, conf double, x1 double, y1 double, x2 double, y2 double, place_name string"


def overlap(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h)


def brute(rows, threshold, least, most, agnostic):
    out = []
    for image in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == image and r[3] is not None and r[3] == r[3] and r[3] >= least), key=lambda r: (-r[3], r[1]))
        kept = []
        for r in own:
            if all(None in r[4:] or None in k[4:] or not (agnostic or k[2] == r[2]) or overlap(k, r) <= threshold for k in kept):
                kept.append(r)
        out += [(r[0], r[1], p + 1) for p, r in enumerate(kept[:most])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("crowd", [5_000, 0])
@pytest.mark.parametrize("agnostic", [False, True])
def test_against_a_plain_loop(spark, monkeypatch, crowd, agnostic):
    monkeypatch.setattr(suppress, "CROWD", crowd)
    rng, rows = random.Random(3), []
    for image, n in (("hot", 300), ("a", 25), ("b", 1)):
        for k in range(n):
            x, y = rng.randrange(0, 900, 4), rng.randrange(0, 60, 3)
            rows.append((image, k, rng.choice([0, 1, None]), round(rng.random(), 2), float(x), float(y), float(x + rng.randrange(20, 90)), float(y + rng.randrange(20, 90))))
    rows += [("a", 90, 1, None, 0.0, 0.0, 9.0, 9.0), ("a", 91, 1, float("nan"), 0.0, 0.0, 9.0, 9.0), ("a", 92, 1, 0.9, None, 0.0, 9.0, 9.0), ("c", 1, 1, 0.1, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for most in (300, 12):
        got = suppress.non_maximum(df, threshold=0.3, least_conf=0.15, most=most, agnostic=agnostic)
        assert got.columns == [*df.columns, "place"]
        assert sorted(repr((r.image_id, r.pr, r.place)) for r in got.collect()) == brute(rows, 0.3, 0.15, most, agnostic)


def test_chain_of_boxes_and_nothing(spark, monkeypatch):
    """Each box overlaps the next, weaker one: every second stays, in whatever way it is decided."""
    rows = [("i", k, 0, 1 - k / 100, 10.0 * k, 0.0, 10.0 * k + 19, 10.0, "x") for k in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    for crowd in (5_000, 0):
        monkeypatch.setattr(suppress, "CROWD", crowd)
        got = suppress.non_maximum(df, threshold=0.2).collect()
        assert sorted(r.pr for r in got) == list(range(0, 24, 2))
    assert suppress.non_maximum(df.limit(0)).count() == 0
