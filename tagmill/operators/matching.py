"""Matching of predictions with true boxes, and what evaluation derives from it.

Boxes meet on (image, tile): a box is dealt to the tiles of a grid that it covers, and a pair counts in the one tile
that holds the upper left corner of its overlap. So only boxes near each other are compared, no pair is seen twice, and
an image with very many boxes is spread over many groups. What reaches the threshold is then assigned greedily; the
fold over an image's candidates runs in the JVM, and very crowded images are matched by rounds of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import error_score, iou
from ..session import cut

CORNERS = ("x1", "y1", "x2", "y2")
#: Candidates of a group that one fold walks through; larger groups are matched by rounds of joins.
CROWD = 20_000


def _side(boxes: DataFrame, prefix: str, keys: list[str], tile: float | None) -> DataFrame:
    """Columns but the keys get a prefix; with ``tile``, a row for each tile that the box covers."""
    rows = boxes.select(*keys, *[F.col(c).alias(prefix + c) for c in boxes.columns if c not in keys])
    for name, axis in (("tx", "x"), ("ty", "y")) if tile else ():
        low, high = F.col(f"{prefix}{axis}1"), F.col(f"{prefix}{axis}2")
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(low / tile), F.floor(F.greatest(low, high) / tile))))
    return rows


def overlaps(left: DataFrame, right: DataFrame, least: float, on: tuple[str, ...] = ("image_id",), tile: float | None = 256.0) -> DataFrame:
    """Pairs with an overlap of ``least`` (above 0) or more: the keys, both rows' columns as a_... and b_..., and iou."""
    keys = list(on)
    pairs = _side(left, "a_", keys, tile).join(_side(right, "b_", keys, tile), [*keys, "tx", "ty"] if tile else keys)
    if tile:
        home = [F.floor(F.greatest(f"a_{x}1", f"b_{x}1") / tile) == F.col(f"t{x}") for x in "xy"]
        pairs = pairs.where(home[0] & home[1]).drop("tx", "ty")
    a, b = ({c: F.col(f"{side}_{c}") for c in CORNERS} for side in "ab")
    return pairs.withColumn("iou", iou(a, b)).where(F.col("iou") >= least)


def greedy(candidates: DataFrame, keys: list[str], first: str, second: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs: ``first`` in ascending order takes the free ``second`` of the largest iou, the smallest of equals.

    As candidates hold only pairs at or above the threshold, walking them in the order (first, -iou, second) and taking
    each whose two sides are free gives just that: one fold a group. Groups of more than CROWD candidates are matched by
    rounds of joins instead, with the same result, so that none has to fit in a row. Columns of ``keep`` go along.
    """
    candidates = cut(candidates.select(*keys, first, second, "iou", *keep))
    crowded = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select(*keys)
    if not crowded.take(1):
        return _fold(candidates, keys, first, second, keep)
    crowded = cut(crowded)
    return _fold(candidates.join(crowded, keys, "left_anti"), keys, first, second, keep).unionByName(_rounds(candidates.join(crowded, keys), keys, first, second, keep))


def _fold(candidates: DataFrame, keys: list[str], first: str, second: str, keep: tuple[str, ...] = ()) -> DataFrame:
    order = F.struct(F.col(first).alias("i"), (-F.col("iou")).alias("v"), F.col(second).alias("j"), *keep)
    rows = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("c"))
    # What is taken: the places in order, the seconds, and the last first; a first is free unless it is that one.
    none = F.lit(None).cast(dict(candidates.dtypes)[first])
    start = F.struct(F.array().cast("array<int>").alias("at"), F.slice(F.transform("c", lambda x: x["j"]), 1, 0).alias("js"), none.alias("i"))

    def take(acc, x, k):
        free = ~F.array_contains(acc["js"], x["j"]) & ~acc["i"].eqNullSafe(x["i"])
        return F.when(free, F.struct(F.array_append(acc["at"], k).alias("at"), F.array_append(acc["js"], x["j"]).alias("js"), x["i"].alias("i"))).otherwise(acc)

    numbered = F.transform("c", lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    taken = F.transform(F.aggregate(numbered, start, lambda acc, y: take(acc, y["x"], y["k"]), lambda acc: acc["at"]), lambda k: F.get(F.col("c"), k))
    return rows.select(*keys, F.inline(taken)).select(*keys, F.col("i").alias(first), F.col("j").alias(second), (-F.col("v")).alias("iou"), *keep)


def _rounds(candidates: DataFrame, keys: list[str], first: str, second: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A round takes each pair that is best for its ``first`` and whose ``second`` no smaller first can claim any more."""
    left, out = cut(candidates), None
    while not left.isEmpty():
        best = left.groupBy(*keys, first).agg(F.min(F.struct((-F.col("iou")).alias("v"), F.col(second).alias("j"), *keep)).alias("b"))
        claim = left.groupBy(*keys, second).agg(F.min(first).alias("_low"))
        best = best.select(*keys, first, F.col("b.j").alias(second), (-F.col("b.v")).alias("iou"), *[f"b.{c}" for c in keep])
        taken = cut(best.join(claim, [*keys, second]).where(F.col(first) == F.col("_low")).select(*keys, first, second, "iou", *keep))
        left = left.join(taken.select(*keys, first), [*keys, first], "left_anti").join(taken.select(*keys, second), [*keys, second], "left_anti")
        left, out = cut(left.select(*keys, first, second, "iou", *keep)), taken if out is None else out.unionByName(taken)
    return candidates.limit(0).select(*keys, first, second, "iou", *keep) if out is None else out


def match(gt: DataFrame, pred: DataFrame, least: float = 0.5, tile: float | None = 256.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each prediction (tp, conf or fp) and each true box left over (fn).

    ``gt``: image_id, gi, cls, corners; ``pred``: image_id, pr (rank by falling confidence), cls, conf, corners. Columns:
    image_id, kind, pr, gi, pred_cls, gt_cls, conf, iou. Matching looks at boxes alone; the class then tells tp from conf.
    Columns of both inputs named in ``keep`` go along as pred_... and gt_....
    """
    found = overlaps(pred, gt, least, tile=tile).select("image_id", F.col("a_pr").alias("pr"), F.col("b_gi").alias("gi"), "iou")
    pairs = greedy(found, ["image_id"], "pr", "gi")
    p = pred.select("image_id", "pr", F.col("cls").alias("pred_cls"), "conf", *[F.col(c).alias(f"pred_{c}") for c in keep]).join(pairs, ["image_id", "pr"], "left")
    g = gt.select("image_id", "gi", F.col("cls").alias("gt_cls"), *[F.col(c).alias(f"gt_{c}") for c in keep])
    both = p.join(g, ["image_id", "gi"], "full")
    kind = F.when(F.col("pr").isNull(), "fn").when(F.col("gi").isNull(), "fp").when(F.col("pred_cls") == F.col("gt_cls"), "tp").otherwise("conf")
    return both.select("image_id", kind.alias("kind"), "pr", "gi", "pred_cls", "gt_cls", "conf", "iou", *[f"{side}_{c}" for side in ("pred", "gt") for c in keep])


def drift(ref: DataFrame, cand: DataFrame, least: float = 0.5, tile: float | None = 256.0) -> DataFrame:
    """Pairs of a reference model's boxes with another's, within image and class: image_id, ref, cand, iou, d_conf.

    Reference boxes choose in model order (pr).
    """
    found = overlaps(ref, cand, least, ("image_id", "cls"), tile)
    rows = found.select("image_id", F.col("a_pr").alias("ref"), F.col("b_pr").alias("cand"), "iou", F.abs(F.col("b_conf") - F.col("a_conf")).alias("d_conf"))
    return greedy(rows, ["image_id"], "ref", "cand", ("d_conf",))


def drift_summary(ref: DataFrame, cand: DataFrame, pairs: DataFrame, lost: float = 0.95, shifted: float = 0.05) -> DataFrame:
    """One row: n_ref, n_cand, matched, ratio, mean_iou, mean_d_conf, verdict."""
    one = pairs.agg(F.count(F.lit(1)).alias("matched"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.avg("d_conf"), F.lit(0.0)).alias("mean_d_conf"))
    rows = ref.agg(F.count(F.lit(1)).alias("n_ref")).crossJoin(cand.agg(F.count(F.lit(1)).alias("n_cand"))).crossJoin(one)
    rows = rows.withColumn("ratio", F.when(F.col("n_ref") > 0, F.col("matched") / F.col("n_ref")).otherwise(0.0))
    return rows.withColumn("verdict", F.when(F.col("ratio") < lost, "lost").when(F.col("mean_d_conf") > shifted, "confidence shift").otherwise("ok"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_scores(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn, conf_gt and conf_pred (confusions count against both)."""
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("conf_pred"))
    r = _ratio(F.col("tp"), F.col("tp") + F.col("fn") + F.col("conf_gt"))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _ratio(2 * p * r, p + r))


def kinds() -> list[Column]:
    return [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn", "conf")]


def totals(matched: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, conf, n_gt, n_pred, precision, recall, f1."""
    rows = matched.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn", "conf")])
    rows = rows.withColumn("n_gt", F.expr("tp + conf + fn")).withColumn("n_pred", F.expr("tp + conf + fp"))
    return with_scores(rows.withColumn("conf_gt", F.col("conf")).withColumn("conf_pred", F.col("conf"))).drop("conf_gt", "conf_pred")


def confusion(matched: DataFrame, background: int) -> DataFrame:
    """gt_cls, pred_cls, n: false positives under the true class ``background``, missed boxes under that prediction."""
    pair = [F.coalesce("gt_cls", F.lit(background)).alias("gt_cls"), F.coalesce("pred_cls", F.lit(background)).alias("pred_cls")]
    return matched.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(matched: DataFrame, n_classes: int) -> DataFrame:
    """A row a true class (the last: background) with a column p0, p1, ... for each prediction."""
    wide = confusion(matched, n_classes).groupBy("gt_cls").pivot("pred_cls", list(range(n_classes + 1))).agg(F.sum("n"))
    return wide.select("gt_cls", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"p{c}") for c in range(n_classes + 1)])


def class_scores(matched: DataFrame, weak: float = 0.7) -> DataFrame:
    """cls, tp, fp, fn, conf_gt, conf_pred, precision, recall, f1, weak: each class that has a true or predicted box."""
    seen_gt = F.when(F.col("gt_cls").isNotNull(), F.struct(F.col("gt_cls").alias("cls"), F.lit(True).alias("own")))
    seen_pred = F.when(F.col("pred_cls").isNotNull() & (F.col("kind") != "tp"), F.struct(F.col("pred_cls").alias("cls"), F.lit(False).alias("own")))
    # Counted by pair of classes first: what is exploded is a matrix, not the boxes.
    cells = matched.groupBy("kind", "gt_cls", "pred_cls").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select("kind", "n", F.explode(F.array_compact(F.array(seen_gt, seen_pred))).alias("side")).select("kind", "n", "side.*")

    def of(name: str, own: bool, kind: str) -> Column:
        return F.coalesce(F.sum(F.when((F.col("own") == own) & (F.col("kind") == kind), F.col("n"))), F.lit(0)).alias(name)

    rows = sides.groupBy("cls").agg(of("tp", True, "tp"), of("fp", False, "fp"), of("fn", True, "fn"), of("conf_gt", True, "conf"), of("conf_pred", False, "conf"))
    return with_scores(rows).withColumn("weak", F.col("recall") < weak)


def image_scores(matched: DataFrame) -> DataFrame:
    """image_id, tp, fp, fn, conf, score: images with more errors score higher."""
    rows = matched.groupBy("image_id").agg(*kinds())
    return rows.withColumn("score", error_score(F.col("fn"), F.col("fp"), F.col("conf")).cast("double"))


def matched_image_scores(gt: DataFrame, pred: DataFrame, least: float = 0.5, tile: float | None = 256.0) -> DataFrame:
    """``image_scores`` of ``match``, from counts alone: pairs know whether their classes agree, so no box is joined again."""
    same = F.coalesce(F.col("a_cls") == F.col("b_cls"), F.lit(False)).alias("same")
    found = overlaps(pred, gt, least, tile=tile).select("image_id", F.col("a_pr").alias("pr"), F.col("b_gi").alias("gi"), "iou", same)
    pairs = greedy(found, ["image_id"], "pr", "gi", ("same",))
    n = F.count(F.lit(1))
    rows = pairs.groupBy("image_id").agg(n.alias("n_pairs"), F.count_if("same").alias("tp"))
    for k, side in (("n_gt", gt), ("n_pred", pred)):
        rows = rows.unionByName(side.groupBy("image_id").agg(n.alias(k)), allowMissingColumns=True)  # a row an image and side
    sums = rows.groupBy("image_id").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_gt", "n_pred", "n_pairs", "tp")])
    out = sums.selectExpr("image_id", "tp", "n_pred - n_pairs AS fp", "n_gt - n_pairs AS fn", "n_pairs - tp AS conf")
    return out.withColumn("score", error_score(F.col("fn"), F.col("fp"), F.col("conf")).cast("double"))


def worst_images(matched: DataFrame, n: int = 15) -> DataFrame:
    return image_scores(matched).where("score > 0").orderBy(F.col("score").desc(), "image_id").limit(n)


#: Which images a view of the evaluation shows.
EVAL_VIEWS = {"all": "true", "fn": "fn > 0", "fp": "fp > 0", "conf": "conf > 0", "clean": "fn = 0 AND fp = 0 AND conf = 0"}


def eval_view_counts(scores: DataFrame) -> DataFrame:
    """view, n: images in each view."""
    counts = scores.agg(*[F.count_if(F.expr(x)).alias(k) for k, x in EVAL_VIEWS.items()])
    return counts.unpivot([], list(EVAL_VIEWS), "view", "n")
