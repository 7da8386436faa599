"""Greedy matching against a brute-force loop, and what evaluation makes of it."""

from __future__ import annotations

import random

import pytest

from tagmill.operators import matching as M
from tagmill.operators import ranking as R
from tagmill.schemas import GT, PRED


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def brute(gts, preds, least, same_class=False):
    used, out = set(), {}
    for i, p in enumerate(preds):
        best, at = 0.0, -1
        for j, g in enumerate(gts):
            if j in used or (same_class and g[0] != p[0]):
                continue
            v = iou(p[2:], g[1:] if len(g) == 5 else g[2:])
            if v > best:
                best, at = v, j
        if best >= least:
            used.add(at)
            out[i] = at
    return out


@pytest.fixture(scope="module")
def scene():
    rnd, gts, preds = random.Random(5), {}, {}
    for image in range(40):
        def box():
            x, y = rnd.randrange(0, 900), rnd.randrange(0, 300)
            return [x, y, x + rnd.randrange(5, 300), y + rnd.randrange(5, 200)]

        gts[f"i{image}"] = [(rnd.randrange(3), *map(float, box())) for _ in range(rnd.randrange(0, 12))]
        near = [(g[0] if rnd.random() < 0.7 else 2, *(c + rnd.randrange(-15, 15) for c in g[1:])) for g in gts[f"i{image}"] if rnd.random() < 0.9]
        near += near[:2]
        some = [(c[0], round(rnd.random(), 3), *c[1:]) for c in near] + [(rnd.randrange(3), round(rnd.random(), 3), *map(float, box())) for _ in range(rnd.randrange(0, 4))]
        preds[f"i{image}"] = sorted(some, key=lambda p: -p[1])
    return gts, preds


def frames(spark, gts, preds):
    g = spark.createDataFrame([(i, j, *b) for i, bs in gts.items() for j, b in enumerate(bs)], GT)
    p = spark.createDataFrame([(i, j, *b) for i, bs in preds.items() for j, b in enumerate(bs)], PRED)
    return g, p


@pytest.mark.parametrize(("tile", "crowd"), [(None, 20_000), (64.0, 20_000), (256.0, 20_000), (256.0, 5)])
@pytest.mark.parametrize("least", [0.3, 0.5])
def test_match_is_greedy(spark, scene, monkeypatch, tile, crowd, least):
    monkeypatch.setattr(M, "CROWD", crowd)  # above it, rounds of joins give the same pairs
    gts, preds = scene
    g, p = frames(spark, gts, preds)
    rows = M.match(g, p, least, tile).collect()
    have = {(r.image_id, r.pr): r.gi for r in rows if r.pr is not None and r.gi is not None}
    want = {(i, a): b for i in gts for a, b in brute(gts[i], preds[i], least).items()}
    assert have == want
    assert sum(r.kind == "fn" for r in rows) == sum(map(len, gts.values())) - len(want)
    assert all((r.kind == "tp") == (r.pred_cls == r.gt_cls) for r in rows if r.kind in ("tp", "conf"))


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_counts_of_pairs_give_the_scores_of_images(spark, scene, monkeypatch, crowd):
    """The scores of images need no box again: what is numbered is not read a second time for them."""
    from tagmill.plans import manifests

    monkeypatch.setattr(M, "CROWD", crowd)
    gt, pred = frames(spark, *scene)
    for few_gt, few_pred in ((gt, pred), (gt.limit(0), pred), (gt, pred.limit(0)), (gt.limit(0), pred.limit(0))):
        want, got = M.image_scores(M.match(few_gt, few_pred)), M.matched_image_scores(few_gt, few_pred)
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.undo()  # crowded images are matched by joins
    plan = manifests.top_n_manifest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Join" not in plan  # the places of the result


def test_drift_needs_the_class(spark, scene):
    gts, preds = scene
    ref = {i: ps[:8] for i, ps in preds.items()}
    cand = {i: [(*p[:2], *(c + 1 for c in p[2:])) for p in ps] for i, ps in preds.items()}
    _, a = frames(spark, gts, ref)
    _, b = frames(spark, gts, cand)
    have = {(r.image_id, r.ref): r.cand for r in M.drift(a, b).collect()}
    assert have == {(i, x): y for i in ref for x, y in brute(cand[i], ref[i], 0.5, True).items()}


def test_scores_and_matrix(spark):
    gts = {"a": [(0, 0.0, 0.0, 10.0, 10.0), (1, 20.0, 0.0, 30.0, 10.0), (1, 40.0, 0.0, 50.0, 10.0)]}
    preds = {"a": [(0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 0.8, 20.0, 0.0, 30.0, 10.0), (1, 0.7, 80.0, 0.0, 90.0, 10.0)]}
    m = M.match(*frames(spark, gts, preds))
    t = M.totals(m).first()
    assert (t.tp, t.fp, t.fn, t.conf, t.n_gt, t.n_pred) == (1, 1, 1, 1, 3, 3)
    assert t.precision == t.recall == t.f1 == pytest.approx(1 / 3)
    assert {(r.gt_cls, r.pred_cls): r.n for r in M.confusion(m, 2).collect()} == {(0, 0): 1, (1, 0): 1, (2, 1): 1, (1, 2): 1}
    s = {r.cls: r for r in M.class_scores(m).collect()}
    assert (s[0].precision, s[0].recall, s[1].recall, s[1].weak) == (0.5, 1.0, 0.0, True)
    assert M.image_scores(m).first().score == 1 + 1 + 1.5
    wide = {r.gt_cls: (r.p0, r.p1, r.p2) for r in M.confusion_matrix(m, 2).collect()}
    assert wide == {0: (1, 0, 0), 1: (1, 0, 1), 2: (0, 1, 0)}


def test_nothing_to_match(spark):
    g, p = frames(spark, {"a": [(0, 0.0, 0.0, 1.0, 1.0)]}, {})
    assert [r.kind for r in M.match(g, p).collect()] == ["fn"]
    t = M.totals(M.match(g.limit(0), p)).first()
    assert (t.tp, t.precision, t.recall, t.f1) == (0, 0.0, 0.0, 0.0)


def test_active_ranking(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    _, p = frames(spark, {}, {"a": [(0, 0.5, 0.0, 0.0, 1.0, 1.0), (0, 0.9, 0.0, 0.0, 1.0, 1.0)], "b": [(0, 0.3, 0.0, 0.0, 1.0, 1.0), (0, 0.6, 0.0, 0.0, 1.0, 1.0)]})
    rows = R.active_rank(R.active_scores(images, p)).collect()
    assert [(r.image_id, round(r.score, 6)) for r in rows] == [("b", 1.4), ("a", 1.0), ("c", 1.0)]
    with pytest.raises(ValueError):
        R.active_scores(images, p, 0.7, 0.7)


def test_matching_and_drift_read_their_boxes_once(spark):
    """What is shown of a pair goes along with it instead of being joined again."""
    from tagmill.plans import evaluation, suppression

    data = "/root/testdata/sf0.001"
    plans = {f.__name__: f(spark, data)._jdf.queryExecution().optimizedPlan().toString() for f in (evaluation.eval_marks, evaluation.drift_match)}
    assert plans["eval_marks"].count("Window [") == 3 and "Window [" not in plans["drift_match"]
    for crowd in (1, 16):
        boxes = suppression.both(spark, data, crowd)
        boxes.collect()
        assert boxes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange ") == 1


def test_corners_are_not_dealt_over_tiles(spark):
    """Four corners a box are many; the points go to the tiles of their reach instead."""
    from tagmill.plans import hits

    plan = hits.point_handle_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "sequence(" in line]
    assert dealt and not any("cx#" in line or "cy#" in line for line in dealt)


def test_kept_columns_go_along_in_rounds(spark, monkeypatch):
    """Crowded groups, which are matched by rounds of joins, keep the same columns as folds do."""
    from tagmill.operators import matching

    rows = spark.createDataFrame([(i % 2, i % 7, i % 5, 0.5 + i / 200, 10 * i) for i in range(70)], "image_id long, a long, b long, iou double, more long").dropDuplicates(["image_id", "a", "b"])
    fold = sorted(map(tuple, matching.greedy(rows, ["image_id"], "a", "b", ("more",)).collect()))
    monkeypatch.setattr(matching, "CROWD", 3)
    assert sorted(map(tuple, matching.greedy(rows, ["image_id"], "a", "b", ("more",)).collect())) == fold and len(fold) == 10
