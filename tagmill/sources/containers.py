"""Facts about videos (length, rate, tracks) from the boxes of their container, without a codec or another program.

A file of the MP4 and MOV family is a row of nested boxes: four bytes of size, four of type. A task walks the outer boxes by
their sizes, a few bytes each, until it finds ``moov`` at the front or the end of the file, and reads that one alone; the
media data is never read. Files that are cut off, of another format or without ``moov`` give nulls and ``readable`` false.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .stores import listed, opened

ENDINGS = (".mp4", ".mov", ".m4v")
SCHEMA = "path string, length long, readable boolean, duration_ms long, fps double, frames long, width int, height int, has_video boolean, has_audio boolean"
#: A table of contents beyond this is taken for damage (it has some ten bytes a frame).
MOOV_BYTES = 1 << 28


def boxes(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of the content, end) of the boxes that follow each other in ``data``; ends at the first that can't be."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            return
        yield kind, begin + head, begin + size
        begin += size


def _inside(data: bytes, begin: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """The content of the first box at a path of types."""
    for want in path:
        found = next(((b, e) for kind, b, e in boxes(data, begin, end) if kind == want), None)
        if found is None:
            return None
        begin, end = found
    return begin, end


def _clock(data: bytes, at: tuple[int, int]) -> tuple[int, int]:
    """Units a second and units in all, of mvhd and mdhd alike: their version tells the width of numbers."""
    begin, _ = at
    if data[begin] == 1:
        return struct.unpack_from(">IQ", data, begin + 20)
    return struct.unpack_from(">II", data, begin + 12)


def _track(data: bytes, begin: int, end: int) -> dict | None:
    handler, clock = _inside(data, begin, end, b"mdia", b"hdlr"), _inside(data, begin, end, b"mdia", b"mdhd")
    if handler is None or clock is None:
        return None
    scale, units = _clock(data, clock)
    track = {"kind": data[handler[0] + 8 : handler[0] + 12], "scale": scale, "units": units, "frames": 0, "spans": 0, "width": None, "height": None}
    times = _inside(data, begin, end, b"mdia", b"minf", b"stbl", b"stts")
    if times is not None:
        count = struct.unpack_from(">I", data, times[0] + 4)[0]
        for n, delta in struct.iter_unpack(">II", data[times[0] + 8 : min(times[1], times[0] + 8 + 8 * count)]):
            track["frames"] += n
            track["spans"] += n * delta
    sizes = _inside(data, begin, end, b"tkhd")
    if sizes is not None:
        w, h = struct.unpack_from(">II", data, sizes[1] - 8)
        track["width"], track["height"] = w >> 16, h >> 16
    return track


def facts(moov: bytes) -> dict | None:
    """What the content of a ``moov`` box says; None if it has no clock."""
    try:
        clock = _inside(moov, 0, len(moov), b"mvhd")
        if clock is None:
            return None
        scale, units = _clock(moov, clock)
        tracks = [t for kind, b, e in boxes(moov) if kind == b"trak" and (t := _track(moov, b, e)) is not None]
    except (struct.error, IndexError):
        return None
    video = next((t for t in tracks if t["kind"] == b"vide"), None)
    fps = video["frames"] * video["scale"] / video["spans"] if video and video["spans"] else None
    longest = max([units / scale if scale else 0.0, *(t["units"] / t["scale"] for t in tracks if t["scale"])])
    return {
        "duration_ms": round(1000 * (units / scale if scale and units else longest)), "fps": fps, "frames": video["frames"] if video else None, "width": video["width"] if video else None,
        "height": video["height"] if video else None, "has_video": video is not None, "has_audio": any(t["kind"] == b"soun" for t in tracks),
    }


def read_moov(file, length: int) -> bytes | None:
    """The content of the outer ``moov`` box, by reads of the boxes' heads and of it alone."""
    at = 0
    while at + 8 <= length:
        file.seek(at)
        head = file.read(16)
        if len(head) < 8:
            return None
        size, kind = struct.unpack_from(">I4s", head)
        skip = 8
        if size == 1 and len(head) == 16:
            size, skip = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = length - at
        if size < skip or at + size > length:
            return None
        if kind == b"moov":
            if size > MOOV_BYTES:
                return None
            file.seek(at + skip)
            return file.read(size - skip)
        at += size
    return None


def video_facts(spark: SparkSession, root: str) -> DataFrame:
    """SCHEMA of the videos at or below ``root``; each file is read by a task of its own partition."""
    files = list(listed(root, ENDINGS))
    rows = spark.createDataFrame(files, "path string, length long").repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return read_facts(rows)


def read_facts(files: DataFrame) -> DataFrame:
    """SCHEMA of the videos at ``path`` with ``length`` bytes."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                with opened(path) as f:
                    moov = read_moov(f, length)
                found = None if moov is None else facts(moov)
                out.append({"path": path, "length": length, "readable": found is not None} | (found or {}))
            kinds = {"duration_ms": "Int64", "frames": "Int64", "width": "Int32", "height": "Int32", "has_video": "boolean", "has_audio": "boolean", "fps": "Float64"}
            yield pd.DataFrame(out, columns=columns).astype(kinds)

    return files.select("path", "length").mapInPandas(run, SCHEMA)
