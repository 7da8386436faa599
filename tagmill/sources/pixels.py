"""Grey images from PNG and BMP files, means over areas of any size, and the difference hashes of image files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neardup import gradient_hash

#: Pixels of an image that is decoded; a larger one counts as unreadable, which bounds a task's memory.
PIXELS = 1 << 27
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
# First column and row, and their steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Brightness of red, green and blue (last axis) in whole numbers, weighed 0.299, 0.587 and 0.114 to 14 bits."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((4899 * r + 9617 * g + 1868 * b + 8192) >> 14).astype(np.uint8)


def _unfiltered(data: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """A PNG's rows (a filter's number, then ``width`` bytes) without their filters; ``step`` bytes make a pixel."""
    lines = data[: rows * (width + 1)].reshape(rows, width + 1)
    out = np.zeros((rows + 1, width + step), np.int64)  # a row above and a pixel to the left are zero
    for k in range(rows):
        kind, line, up = int(lines[k, 0]), lines[k, 1:].astype(np.int64), out[k]
        row = out[k + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 1:
            pad = -width % step
            row[step:] = (np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0).ravel()[:width]) & 255
        elif kind == 2:
            row[step:] = (line + up[step:]) & 255
        elif kind == 3:
            for i in range(width):
                row[step + i] = (line[i] + ((row[i] + up[step + i]) >> 1)) & 255
        elif kind == 4:
            for i in range(width):
                a, b, c = row[i], up[step + i], up[i]
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                row[step + i] = (line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        else:
            raise ValueError("unknown filter")
    return out[1:, step:].astype(np.uint8)


def _samples(raw: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """Rows of bytes as numbers (rows, width, channels); of 16 bits the upper eight."""
    if depth == 16:
        raw = raw[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(raw, axis=1)[:, : raw.shape[1] * 8]
        bits = bits.reshape(len(raw), -1, depth)
        raw = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return raw[:, : width * channels].reshape(len(raw), width, channels)


def read_png(content: bytes) -> np.ndarray | None:
    """The grey image of a PNG of any colour type and depth, interlaced or not; transparency is ignored."""
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        return None
    w, h, depth, colour, _, _, laced = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or not 0 < w * h <= PIXELS:
        return None
    channels = _CHANNELS[colour]
    line = lambda n: (n * channels * depth + 7) // 8  # noqa: E731  bytes of a row of n pixels
    step = max(1, channels * depth // 8)
    parts = [(x, y, dx, dy) for x, y, dx, dy in _PASSES if x < w and y < h] if laced else [(0, 0, 1, 1)]
    need = sum(-(-(h - y) // dy) * (1 + line(-(-(w - x) // dx))) for x, y, dx, dy in parts)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(data), need), np.uint8)
    if len(raw) < need:
        return None
    out, at = np.zeros((h, w, channels), np.uint8), 0
    for x, y, dx, dy in parts:
        n, m = -(-(w - x) // dx), -(-(h - y) // dy)
        out[y::dy, x::dx] = _samples(_unfiltered(raw[at:], m, line(n), step), n, depth, channels)
        at += m * (1 + line(n))
    if colour == 3:
        return None if palette is None or out.max() >= len(palette) else grey_of(palette[out[..., 0]])
    if colour in (2, 6):
        return grey_of(out)
    return out[..., 0] if depth >= 8 else (out[..., 0].astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)


def read_bmp(content: bytes) -> np.ndarray | None:
    """The grey image of an uncompressed BMP with 8 (palette), 24 or 32 bits a pixel."""
    begin, size, w, h, _, depth, packed = struct.unpack_from("<IIiiHHI", content, 10)
    rows = abs(h)
    line = (w * depth + 31) // 32 * 4
    if packed not in (0, 3) or depth not in (8, 24, 32) or w <= 0 or not 0 < w * rows <= PIXELS or len(content) < begin + line * rows:
        return None
    raw = np.frombuffer(content, np.uint8, line * rows, begin).reshape(rows, line)
    if depth == 8:
        used = struct.unpack_from("<I", content, 46)[0] or 256
        palette = np.frombuffer(content, np.uint8, 4 * used, 14 + size).reshape(-1, 4)
        grey = grey_of(palette[:, [2, 1, 0]])[raw[:, :w]] if raw[:, :w].max() < used else None
    else:
        grey = grey_of(raw[:, : w * depth // 8].reshape(rows, w, depth // 8)[..., [2, 1, 0]])
    return grey if grey is None or h < 0 else grey[::-1]  # a positive height stands for rows from below


def decode(content: bytes | None) -> np.ndarray | None:
    """The grey image (rows of bytes) of a PNG or BMP; None for other formats and damaged files."""
    try:
        if content and content[:8] == b"\x89PNG\r\n\x1a\n":
            return read_png(bytes(content))
        if content and content[:2] == b"BM":
            return read_bmp(bytes(content))
    except (struct.error, zlib.error, ValueError, IndexError):
        return None
    return None


def area_means(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The means of width x height equal parts of an image, rounded to whole numbers (halves to even).

    Parts may end within pixels. They are differences of a table of sums over all pixels above and to the left, which is
    linear between pixels; so a part costs four look-ups, whatever its size.
    """
    h, w = image.shape
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def along(table: np.ndarray, n: int, parts: int) -> np.ndarray:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(int), n - 1)
        share = (at - low)[:, None]
        return table[low] * (1 - share) + table[low + 1] * share

    grid = along(along(sums, h, height).T, w, width).T
    means = (grid[1:, 1:] - grid[1:, :-1] - grid[:-1, 1:] + grid[:-1, :-1]) / ((h / height) * (w / width))
    return np.rint(np.round(means, 9)).clip(0, 255).astype(np.uint8)


def scaled_images(spark: SparkSession, root: str, width: int = 9, height: int = 8) -> DataFrame:
    """path, readable, pixels (array of width x height grey means) of the PNG and BMP files below ``root``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode(content)
                out.append((path, image is not None, None if image is None else area_means(image, width, height).ravel().tolist()))
            yield pd.DataFrame(out, columns=["path", "readable", "pixels"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = rows.where(F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).isin("png", "bmp"))
    return named.select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"), "content").mapInPandas(run, "path string, readable boolean, pixels array<int>")


def image_hashes(spark: SparkSession, root: str) -> DataFrame:
    """path, readable, hash (64 bits) of the PNG and BMP files below ``root``; null where the file can't be read."""
    found = scaled_images(spark, root)
    return found.select("path", "readable", F.when(F.col("readable"), gradient_hash(F.col("pixels"))).alias("hash"))
