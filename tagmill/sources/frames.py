"""Frames of raw video files (YUV4MPEG2) as a data source: only the frames asked for are read.

``register(spark)`` once, then ``spark.read.format("rawframes").option("stride", 5).load(folder)`` gives path, frame_no (from
0), ts_ms, width, height and grey (the brightness plane, row by row). Frames are of equal size, so a task seeks to each; the
frames between two of a stride aren't touched. Filters on frame_no and path are pushed down: they take away partitions, and
frames within them. The options ``start`` and ``end`` (frame numbers, end exclusive) do the same and tell where the stride
begins; ``pixels = false`` leaves ``grey`` null and reads nothing but the files' first lines.

The driver lists the files and reads the first line (a few bytes) of each that no filter takes away; a partition is a run of
up to ``frames_each`` wanted frames of one file. A file cut off in the middle of a frame ends before it; an empty file or one of
another format has no frames, unless ``strict = true``.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .stores import listed, opened

SCHEMA = "path string, frame_no long, ts_ms double, width int, height int, grey binary"
FRAMES_EACH, READERS, HEAD = 256, 16, 1024
ENDLESS = 1 << 62
_MARK = b"FRAME\n"


@dataclass(frozen=True)
class Header:
    """A file's first line: where frames begin, their size in the file, and their rate."""

    begin: int
    width: int
    height: int
    size: int
    rate: float


def parse_header(head: bytes) -> Header | None:
    """None if it isn't the beginning of such a file."""
    line, _, rest = head.partition(b"\n")
    words = line.split(b" ")
    if words[0] != b"YUV4MPEG2" or len(line) == len(head):
        return None
    given = {w[:1]: w[1:].decode("latin-1") for w in words[1:] if w}
    try:
        w, h = int(given[b"W"]), int(given[b"H"])
        num, _, den = given.get(b"F", "25:1").partition(":")
        rate = int(num) / int(den) if int(num) > 0 and int(den) > 0 else 25.0
    except (KeyError, ValueError):
        return None
    colour, half_w, half_h = given.get(b"C", "420"), -(-w // 2), -(-h // 2)
    # Names of the layouts of planes of one byte a pixel.
    planes = {"420": 2 * half_w * half_h, "420jpeg": 2 * half_w * half_h, "420mpeg2": 2 * half_w * half_h, "420paldv": 2 * half_w * half_h, "422": 2 * half_w * h, "444": 2 * w * h, "mono": 0}
    if w <= 0 or h <= 0 or colour not in planes:
        return None
    return Header(len(line) + 1, w, h, len(_MARK) + w * h + planes[colour], rate)


@dataclass
class FrameRange(InputPartition):
    """Frames first, first + stride, ... below ``last`` of a file."""

    path: str
    header: Header
    first: int
    last: int

    def __post_init__(self) -> None:
        super().__init__(None)


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawFrameReader:
        return RawFrameReader(self.options)


class RawFrameReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.stride, self.start, self.end = int(options.get("stride", 1)), int(options.get("start", 0)), int(options.get("end", ENDLESS))
        self.each = int(options.get("frames_each", FRAMES_EACH))
        if self.stride < 1 or self.start < 0 or self.each < 1:
            raise ValueError("stride and frames_each must be 1 or more, start 0 or more")
        self.pixels, self.strict = options.get("pixels", "true").lower() == "true", options.get("strict", "false").lower() == "true"
        self.low, self.high, self.paths = self.start, self.end, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of frame_no and equal paths are taken; Spark tests the others itself."""
        for f in filters:
            number = getattr(f, "attribute", None) == ("frame_no",) and type(getattr(f, "value", None)) is int
            if number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif number and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif number and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif getattr(f, "attribute", None) == ("path",) and isinstance(f, EqualTo):
                self.paths = {f.value} if self.paths is None else self.paths & {f.value}
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        files = [(p, n) for p, n in listed(self.root, (".y4m",)) if self.paths is None or p in self.paths]

        def head(path: str) -> Header | None:
            with opened(path) as f:
                return parse_header(f.read(HEAD))

        with ThreadPoolExecutor(READERS) as pool:
            heads = list(pool.map(head, [p for p, _ in files]))
        out = []
        for (path, length), header in zip(files, heads, strict=True):
            if header is None:
                if self.strict:
                    raise ValueError(f"{path} isn't a raw video file that can be read")
                continue
            first = self.start + -(-max(0, self.low - self.start) // self.stride) * self.stride
            last = min(self.high, (length - header.begin) // header.size)
            step = self.stride * self.each
            out += [FrameRange(path, header, at, min(last, at + step)) for at in range(first, last, step)]
        return out or [FrameRange("", Header(0, 0, 0, 1, 1.0), 0, 0)]  # a scan has one partition at least

    def read(self, part: FrameRange) -> Iterator[pa.RecordBatch]:
        h, rows = part.header, []
        numbers = range(part.first, part.last, self.stride)
        if not self.pixels:
            rows = [(n, None) for n in numbers]
        elif numbers:
            with opened(part.path) as f:
                for n in numbers:
                    f.seek(h.begin + n * h.size)
                    frame = f.read(len(_MARK) + h.width * h.height)
                    if not frame.startswith(_MARK):
                        raise ValueError(f"frame {n} of {part.path} has parameters of its own or another size")
                    rows.append((n, frame[len(_MARK) :]))
                    if len(rows) * h.width * h.height > 1 << 24:
                        yield self._batch(part, rows)
                        rows = []
        if rows:
            yield self._batch(part, rows)

    def _batch(self, part: FrameRange, rows: list[tuple[int, bytes | None]]) -> pa.RecordBatch:
        n, h = len(rows), part.header
        columns = [pa.array([part.path] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([1000 * r[0] / h.rate for r in rows], pa.float64()), pa.array([h.width] * n, pa.int32()), pa.array([h.height] * n, pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


def register(spark: SparkSession) -> None:
    """Makes the format ``rawframes`` known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFrames)


def stride_of(fps: float, wanted: float) -> int:
    """Every how many frames one is taken for ``wanted`` frames a second (0 or less: each)."""
    return max(1, round(fps / wanted)) if wanted > 0 else 1


def frame_range(start_ms: float | None, end_ms: float | None, fps: float, total: int) -> tuple[int, int]:
    """First frame and end for a time range; the whole video if one side is missing or the range is empty."""
    whole = (0, total if total > 0 else ENDLESS)
    if start_ms is None or end_ms is None:
        return whole
    first, end = max(0, int(start_ms / 1000.0 * fps)), int(end_ms / 1000.0 * fps)
    end = min(total, end) if total > 0 else end
    return (first, end) if end > first else whole
