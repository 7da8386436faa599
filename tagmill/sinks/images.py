"""Frames written as images, each whole or not at all."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .files import clean_up, put
from .labels import FRAME_NAME

SCHEMA = "path string, frame_no long, target string, length long, status string"


def grey_png(image: np.ndarray) -> bytes:
    """A PNG of a grey image (rows of bytes). Rows are stored as differences from the row above, which packs well."""
    h, w = image.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 0] = 2
    rows[:, 1:] = np.diff(image, axis=0, prepend=np.zeros((1, w), np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def numbered_targets(frames: DataFrame, folder: str, pattern: str = FRAME_NAME.rsplit(".", 1)[0] + ".png") -> Column:
    """The address of each frame's image: a folder a video, and the frames' places in it (from 1) by frame_no."""
    number = F.row_number().over(W.partitionBy("path").orderBy("frame_no"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.concat(F.lit(folder.rstrip("/") + "/"), stem, F.lit("/"), F.format_string(pattern, number))


def write_frames(frames: DataFrame, folder: str, target: Column | None = None, job: str | None = None) -> DataFrame:
    """path, frame_no, target, length, status of ``frames`` (path, frame_no, width, height, grey) written below ``folder``.

    Places are numbered before pixels are read: the numbers are joined to the frames, so no video's pixels meet in one task.
    Tasks that run twice leave one image. Frames without pixels are left out.
    """
    job = job or uuid.uuid4().hex
    named = frames.select("path", "frame_no")
    named = named.withColumn("target", numbered_targets(named, folder) if target is None else target)
    rows = frames.where("grey IS NOT NULL").join(named, ["path", "frame_no"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, n, at, w, h, grey in zip(pdf["path"], pdf["frame_no"], pdf["target"], pdf["width"], pdf["height"], pdf["grey"], strict=True):
                out.append((path, n, at, *put(grey_png(np.frombuffer(grey, np.uint8).reshape(h, w)), at, job)))
            yield pd.DataFrame(out, columns=["path", "frame_no", "target", "length", "status"])

    at = f"{folder.rstrip('/')}/_frames-{job}"
    rows.select("path", "frame_no", "target", "width", "height", "grey").mapInPandas(run, SCHEMA).write.mode("overwrite").parquet(at)
    clean_up(folder, job)
    return frames.sparkSession.read.schema(SCHEMA).parquet(at)
