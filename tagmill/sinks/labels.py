"""Label text, manifests and dataset descriptions.

Manifests are tables: which file goes where under which name. Copying files is left to whoever owns the store.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_line(cls: Column, *numbers: Column, conf: Column | None = None) -> Column:
    """``class x y w h`` with six decimals, and the confidence with four.

    Digits are those of C and Python (the exact binary value, half to even), which Spark's format_string rounds otherwise.
    """

    @F.pandas_udf("string")
    def text(cls: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([f"{int(c)} {a:.6f} {b:.6f} {d:.6f} {e:.6f}" for c, a, b, d, e in zip(cls, x, y, w, h, strict=True)])

    line = text(cls, *numbers)
    if conf is None:
        return line

    @F.pandas_udf("string")
    def four(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.4f}")

    return F.concat_ws(" ", line, four(conf))


def label_texts(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """image_id, text of every image's label file; an image without boxes gets an empty one. ``boxes``: image_id, box_no, cls, cx, cy, w, h."""
    lines = boxes.select("image_id", "box_no", label_line(F.col("cls"), *[F.col(c) for c in ("cx", "cy", "w", "h")]).alias("line"))
    texts = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_no", "line"))).alias("l"))
    rows = images.select("image_id").join(texts, "image_id", "left")
    return rows.select("image_id", F.when(F.col("l").isNull(), "").otherwise(F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))).alias("text"))


def write_label_files(texts: DataFrame, folder: str) -> DataFrame:
    """One file a row (stem, text) in ``folder``, written by the tasks; returns stem and path of what was written.

    The store must be one that pyarrow and Spark both reach. A task that runs again writes the same bytes to the same names.
    """

    def write(parts):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        for pdf in parts:
            for name, text in zip(pdf["stem"], pdf["text"], strict=True):
                with where.open_output_stream(f"{root}/{name}.txt") as out:
                    out.write(text.encode())
            yield pd.DataFrame({"stem": pdf["stem"], "path": folder + "/" + pdf["stem"] + ".txt"})

    return texts.select("stem", "text").mapInPandas(write, "stem string, path string")


def split_manifest(assigned: DataFrame, root: str) -> DataFrame:
    """path, split, target: where each image of a split belongs."""
    return assigned.select("path", "split", F.concat(F.lit(root.rstrip("/") + "/"), "split", F.lit("/images/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("target"))


def write_split_lists(assigned: DataFrame, folder: str) -> None:
    """Lists of paths, a folder of text files a part; nothing is copied."""
    assigned.select("path", "split").write.mode("overwrite").partitionBy("split").text(folder)


def quarantine_manifest(audited: DataFrame, what: str = "dup") -> DataFrame:
    """image_id, reason of images to be set aside: surplus copies (dup) or images with errors (err). The rest must be audited again."""
    chosen = {"dup": "dup_group IS NOT NULL AND NOT dup_rep", "err": "n_errors > 0"}[what]
    return audited.where(chosen).select("image_id", F.lit(what).alias("reason"))


def top_n_manifest(ranked: DataFrame, score: str, n: int) -> DataFrame:
    """place, image_id of the ``n`` best by ``score``."""
    from pyspark.sql.window import Window as W

    top = ranked.orderBy(F.col(score).desc(), "image_id").limit(n)  # n rows reach the window
    return top.select((F.row_number().over(W.orderBy(F.col(score).desc(), "image_id"))).alias("place"), "image_id", score)


# Fixed value: names of extracted frames.
FRAME_NAME = "kare_%05d.jpg"


def frame_manifest(videos: DataFrame, interval_ms: int, pattern: str = FRAME_NAME) -> DataFrame:
    """video_id, number, ts_ms, name of frames taken every ``interval_ms`` between start_ms and end_ms."""
    times = F.posexplode(F.sequence(F.col("start_ms"), F.col("end_ms") - 1, F.lit(interval_ms).cast("long"))).alias("pos", "ts_ms")
    rows = videos.where("end_ms > start_ms").select("video_id", times)
    return rows.select("video_id", (F.col("pos") + 1).alias("number"), "ts_ms", F.format_string(pattern, F.col("pos") + 1).alias("name"))


def clip_manifest(clips: DataFrame, prefix: Column, ext: Column, least_ms: int = 50) -> DataFrame:
    """``clips`` (index, start_ms, end_ms, duration_ms) with end_ms held to the duration, name and problem (null if it can be cut)."""
    from ..functions.text import clip_name
    from ..functions.timefmt import range_problem

    problem = range_problem(F.col("start_ms"), F.col("end_ms"), F.col("duration_ms"), least_ms)
    return clips.withColumn("problem", problem).withColumn("end_ms", F.least("end_ms", "duration_ms")).withColumn("name", clip_name(prefix, F.col("index"), ext))


def dataset_yaml(root: str, names: Sequence[str], train: str = "train/images", val: str = "val/images", test: str = "") -> str:
    """A dataset description."""
    lines = [f"path: {root}", f"train: {train}", f"val: {val or train}", *([f"test: {test}"] if test else []), f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *[f"  {i}: {n}" for i, n in enumerate(names)]]) + "\n"


def write_description(spark: SparkSession, folder: str, root: str, names: Sequence[str], **parts: str) -> None:
    """data.yaml's and classes.txt's lines as two folders of one text file each."""
    for name, text in (("data_yaml", dataset_yaml(root, names, **parts)), ("classes", "\n".join(names))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def report(rows: DataFrame, folder: str) -> None:
    """A table's rows as lines of text."""
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.mode("overwrite").text(folder)
