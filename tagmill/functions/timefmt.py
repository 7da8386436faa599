"""Durations in milliseconds as text and back, and frame arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(x: Column) -> Column:
    """At least two digits."""
    s = x.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def ms_to_clock(ms: Column) -> Column:
    """MM:SS.mmm without hours; negative counts as 0."""
    v = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.concat(_two(F.floor(v / 60000)), F.lit(":"), _two(F.floor(v % 60000 / 1000)), F.lit("."), F.lpad((v % 1000).cast("string"), 3, "0"))


def ms_to_ffmpeg(ms: Column) -> Column:
    """HH:MM:SS.mmm; negative counts as 0."""
    v = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.concat(_two(F.floor(v / 3600000)), F.lit(":"), _two(F.floor(v % 3600000 / 60000)), F.lit(":"), _two(F.floor(v % 60000 / 1000)), F.lit("."), F.lpad((v % 1000).cast("string"), 3, "0"))


def clock_to_ms(text: Column) -> Column:
    """Seconds with comma or dot, after up to two whole-numbered parts for minutes and hours; -1 if it isn't that."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    good = t.rlike(r"^(?:(?:[+-]?[0-9]+:)?[+-]?[0-9]+:)?[+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    parts = F.split(t, ":")
    n = F.size(parts)
    seconds = F.element_at(parts, -1).try_cast("double")
    minutes = F.when(n >= 2, F.try_element_at(parts, F.lit(-2)).try_cast("long")).otherwise(0)
    hours = F.when(n == 3, F.try_element_at(parts, F.lit(1)).try_cast("long")).otherwise(0)
    return F.coalesce(F.when(good, F.bround((seconds + minutes * 60 + hours * 3600) * 1000, 0).try_cast("long")), F.lit(-1).cast("long"))


def frame_clock_to_ms(text: Column) -> Column:
    """The frame tool's dialect: minutes before the first colon, a fraction of which three digits count, no comma."""
    t = F.trim(text)
    left = F.when(F.contains(t, F.lit(":")), F.substring_index(t, ":", 1)).otherwise("0")
    right = F.when(F.contains(t, F.lit(":")), F.substring(t, F.instr(t, ":") + 1, F.length(t))).otherwise(t)
    whole = F.substring_index(right, ".", 1)
    fraction = F.when(F.contains(right, F.lit(".")), F.rpad(F.substring(F.substring(right, F.instr(right, ".") + 1, F.length(right)), 1, 3), 3, "0")).otherwise("000")
    number = r"^\s*[+-]?[0-9]+\s*$"
    good = left.rlike(number) & whole.rlike(number) & fraction.rlike("^[0-9]{3}$")
    ms = (F.trim(left).try_cast("long") * 60 + F.trim(whole).try_cast("long")) * 1000 + fraction.try_cast("long")
    return F.coalesce(F.when(good, ms), F.lit(-1).cast("long"))


def fps_text(interval: Column) -> Column:
    """The rate argument for one frame every ``interval`` seconds."""
    rate = F.bround(1 / interval, 4)
    return F.when(interval >= 1, F.concat(F.lit("1/"), interval.cast("string"))).otherwise(rate.cast("string"))


def frame_window(start_ms: Column, end_ms: Column, fps: Column, total: Column, sample_fps: Column) -> dict[str, Column]:
    """first_frame, end_frame, stride, out_fps and estimate for a sampled range; an invalid range means the whole video."""
    first = F.greatest(F.lit(0).cast("long"), (start_ms / 1000.0 * fps).cast("long"))
    last = F.least(total, (end_ms / 1000.0 * fps).cast("long"))
    good = start_ms.isNotNull() & end_ms.isNotNull() & (last > first)
    start, end = F.when(good, first).otherwise(F.lit(0).cast("long")), F.when(good, last).otherwise(total)
    stride = F.when(sample_fps > 0, F.greatest(F.lit(1).cast("long"), F.bround(fps / sample_fps, 0).cast("long"))).otherwise(F.lit(1).cast("long"))
    estimate = F.when(end <= start, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor((end - start + stride - 1) / stride)))
    return {"first_frame": start, "end_frame": end, "stride": stride, "out_fps": F.greatest(F.lit(1.0), fps / stride), "estimate": estimate}


def frame_ms(fps: Column) -> Column:
    """Milliseconds a frame; 40 where the rate is unknown."""
    return F.when(fps > 0, F.bround(1000 / fps, 0).cast("long")).otherwise(F.lit(40).cast("long"))


def range_problem(start_ms: Column, end_ms: Column, duration_ms: Column, least: int = 50) -> Column:
    """Why a clip range can't be cut, or null; the end is first cut to the duration."""
    end = F.least(end_ms, duration_ms)
    return F.when(end <= start_ms, "end before start").when(end - start_ms < least, "too short")
