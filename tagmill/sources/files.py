"""Files of a dataset: listings, sizes from image headers and label text. Only Spark's readers touch the paths."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, stem

# File name endings of images.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
#: Bytes at the head of a file within which a size is looked for first.
HEAD = 1 << 16


def _placed(path: str, root: str) -> dict[str, Column]:
    """path (without a scheme), rel_dir below ``root``, stem and ext of a listed file."""
    plain = F.regexp_replace(path, "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/")
    inside = F.when(F.startswith(plain, F.lit(base + "/")), F.substring(plain, len(base) + 2, 1 << 30)).otherwise(plain)
    folder = F.regexp_replace(F.regexp_extract(inside, "^(.*)/[^/]*$", 1), "^/", "")
    return {"path": plain, "rel_dir": folder, "stem": stem(plain), "ext": F.lower(F.regexp_extract(base_name(plain), r"(?<=.)\.([^.]*)$", 1))}


def list_files(spark: SparkSession, root: str, endings: tuple[str, ...]) -> DataFrame:
    """Files below ``root`` by their ending; contents aren't read, as the column is pruned. Spark's readers skip empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = found.select(*[x.alias(k) for k, x in _placed("path", root).items()], "length")
    return rows.where(F.col("ext").isin(*endings))


def list_labels(spark: SparkSession, root: str) -> DataFrame:
    """All label files below ``root``, empty ones (images without an object) included.

    The empty ones come from the store's own listing on the driver, which Spark makes for every read as well.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    every, empty = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while every.hasNext():
        status = every.next()
        if not status.getLen() and status.getPath().getName().lower().endswith(".txt"):
            empty.append((status.getPath().toString(), 0))
    rows = spark.createDataFrame(empty, "path string, length long")
    return list_files(spark, root, ("txt",)).unionByName(rows.select(*[x.alias(k) for k, x in _placed("path", root).items()], "length"))


def hidden_folder(rel_dir: Column, names: tuple[str, ...] = ("labels", "__pycache__")) -> Column:
    """Whether a folder, or one it lies in, is hidden (begins with a dot) or has one of the names."""
    return F.exists(F.split(rel_dir, "/"), lambda x: x.startswith(".") | x.isin(*names) if names else x.startswith("."))


def list_images(spark: SparkSession, root: str, skip_hidden: bool = False) -> DataFrame:
    """Images below ``root``; with ``skip_hidden`` not those in label or hidden folders (Spark itself lists no names with a leading dot or underscore)."""
    rows = list_files(spark, root, IMAGE_ENDINGS)
    return rows.where(~hidden_folder(F.col("rel_dir"))) if skip_hidden else rows


def read_label_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_dir, stem, length, line_no, line of the label files below ``root``.

    Empty files have no lines; ``list_labels`` shows them.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    files = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), "value")
    lines = F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("pos", "line")
    out = files.select(*[x.alias(k) for k, x in _placed("path", root).items()], "length", lines)
    return out.select("path", "rel_dir", "stem", "length", (F.col("pos") + 1).alias("line_no"), "line")


def _png(b: bytes):
    return struct.unpack(">II", b[16:24]) if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24 else None


def _bmp(b: bytes):
    if b[:2] != b"BM" or len(b) < 26:
        return None
    w, h = struct.unpack("<ii", b[18:26])
    return w, abs(h)


def _jpeg(b: bytes):
    if b[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD9:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _webp(b: bytes):
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP" or len(b) < 30:
        return None
    if b[12:16] == b"VP8X":
        return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
    if b[12:16] == b"VP8L" and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if b[12:16] == b"VP8 " and b[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff(b: bytes):
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(b[:4])
    if order is None or len(b) < 8:
        return None
    at = struct.unpack(order + "I", b[4:8])[0]
    if len(b) < at + 2:
        return None
    found = {}
    for k in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12:
            tag, kind = struct.unpack(order + "HH", entry[:4])
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return (found[256], found[257]) if 256 in found and 257 in found else None


def header_size(content: bytes | None) -> tuple[int, int]:
    """Width and height from a PNG, BMP, JPEG, WebP or TIFF header; (0, 0) if there is none."""
    if content is not None and len(content):
        for read in (_png, _bmp, _jpeg, _webp, _tiff):
            found = read(bytes(content))
            if found:
                return int(found[0]), int(found[1])
    return 0, 0


def image_sizes(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height of images below ``root``, from their headers.

    A file's first HEAD bytes go to Python; the whole of it only where its header lies later.
    """

    @F.pandas_udf("width int, height int")
    def size(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(b) for b in content], columns=["width", "height"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path")
    found = rows.where(ending.isin(*IMAGE_ENDINGS)).select(plain, "length", "content", size(F.substring("content", 1, HEAD)).alias("s"))
    later = (F.col("s.width") == 0) & (F.col("length") > HEAD)
    found = found.select("path", "s", size(F.when(later, F.col("content"))).alias("t"))
    return found.select("path", *[F.greatest(f"s.{x}", f"t.{x}").alias(x) for x in ("width", "height")])


def frame_filter(frames: DataFrame, start: Column, end: Column, stride: Column) -> DataFrame:
    """Every ``stride``-th frame from ``start`` up to, not including, ``end``."""
    n = F.col("frame_no")
    return frames.where((n >= start) & (n < end) & ((n - start) % stride == 0))
