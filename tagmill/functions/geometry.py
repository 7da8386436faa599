"""Boxes as columns: conversions, overlap, sizes. All functions are built-in expressions inside one codegen stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, EDGE, DEGENERATE = 1e-6, 1e-3, 1e-6


def xywhn_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre form to pixel corners."""
    return {"x1": (cx - w / 2) * width, "y1": (cy - h / 2) * height, "x2": (cx + w / 2) * width, "y2": (cy + h / 2) * height}


def to_centre(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel corners in any order to normalised centre form."""
    return {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": F.abs(x2 - x1) / width, "h": F.abs(y2 - y1) / height}


def to_pixels(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre form to whole pixel corners, truncated towards zero."""
    return {k: v.cast("int") for k, v in xywhn_to_xyxy(cx, cy, w, h, width, height).items()}


def clip_to_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """A top-left box cut to the canvas, as normalised centre form; ``clipped`` and ``degenerate`` tell what happened."""
    x1, y1 = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    x2, y2 = F.least(width, x + w), F.least(height, y + h)
    out = {"cx": (x1 + x2) / 2 / width, "cy": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}
    out["clipped"] = (F.abs(x1 - x) > DEGENERATE) | (F.abs(y1 - y) > DEGENERATE) | (F.abs(x2 - x - w) > DEGENERATE) | (F.abs(y2 - y - h) > DEGENERATE)
    out["degenerate"] = (x2 - x1 <= DEGENERATE) | (y2 - y1 <= DEGENERATE)
    return out


def corners_to_size(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    """Corners to top-left and size."""
    return {"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}


def iou(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
    """Overlap of two boxes (structs or dicts of columns) with x1, y1, x2, y2; 0 without overlap or area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = w * h
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - both
    return F.when((w <= 0) | (h <= 0) | (union <= 0), 0.0).otherwise(both / union)


def area_bucket(area: Column, small: float = 0.005, medium: float = 0.05) -> Column:
    return F.when(area < small, "small").when(area < medium, "medium").otherwise("large")


def overflows(cx: Column, cy: Column, w: Column, h: Column, slack: float = EDGE) -> Column:
    """Whether a normalised box leaves the canvas by more than ``slack``."""
    return (cx - w / 2 < -slack) | (cy - h / 2 < -slack) | (cx + w / 2 > 1 + slack) | (cy + h / 2 > 1 + slack)


def box_key(cls: Column, *coords: Column, digits: int = 5) -> Column:
    """What makes two boxes the same: class and coordinates to ``digits`` places (half to even, as Python rounds)."""
    return F.struct(cls.alias("cls"), *[F.bround(c, digits).alias(f"k{i}") for i, c in enumerate(coords)])


def uncertainty(conf: Column) -> Column:
    """1 at a confidence of 0.5, 0 at 0 and 1."""
    return 1 - F.abs(2 * conf - 1)


def error_score(fn: Column, fp: Column, conf: Column) -> Column:
    return fn + fp + 1.5 * conf


def step_confidence(kept: Column, deviation: Column) -> Column:
    """Of one tracking step: the share of points kept and how little they scatter."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * kept + 0.5 * (1 - F.least(F.lit(1.0), deviation / 2))))


def chain_confidence(flow: Column, likeness: Column) -> Column:
    """Of a chain: flow and likeness to the first frame."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * flow + 0.65 * F.least(F.lit(1.0), likeness / 0.8)))


def contains(x: Column, y: Column, box: Column) -> Column:
    """Point in box, edges included."""
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def moved(box: Column, dx: Column, dy: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box shifted as far as the canvas allows."""
    sx = F.least(F.greatest(dx, -box["x1"]), width - box["x2"])
    sy = F.least(F.greatest(dy, -box["y1"]), height - box["y2"])
    return {"x1": box["x1"] + sx, "y1": box["y1"] + sy, "x2": box["x2"] + sx, "y2": box["y2"] + sy}
