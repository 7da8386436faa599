"""Files of a manifest copied or linked to where they belong, by tasks that may run twice or die.

A task writes each copy under a name of its own attempt beside the target and renames it when it is whole, so a target is
never half a file, and two attempts at one row leave one target. What dead attempts leave behind bears the job's number and
is removed at the end; then the manifest of what stands where is written, whose presence tells that the job is whole. Running
a job again finishes it: copies that stand with their full size are left as they are. A link keeps whatever is at its target.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "source string, target string, length long, status string"
#: Bytes carried at once.
CHUNK = 1 << 20


def attempt_name(target: str, job: str) -> str:
    return f"{target}.{job}.{uuid.uuid4().hex}.part"


def _copy(source: str, target: str, job: str) -> tuple[int | None, str]:
    """Bytes and status: copied, kept (already there), missing (no source) or failed."""
    try:
        store, inside = fs.FileSystem.from_uri(source)
        info = store.get_file_info(inside)
        if info.type != fs.FileType.File:
            return None, "missing"
        to, place = fs.FileSystem.from_uri(target)
        there = to.get_file_info(place)
        if there.type == fs.FileType.File and there.size == info.size:
            return info.size, "kept"
        to.create_dir(place.rsplit("/", 1)[0], recursive=True)
        part = attempt_name(place, job)
        with store.open_input_stream(inside) as one, to.open_output_stream(part) as other:
            while chunk := one.read(CHUNK):
                other.write(chunk)
        if there.type == fs.FileType.File:
            to.delete_file(place)
        to.move(part, place)
        return info.size, "copied"
    except OSError:
        return None, "failed"


def put(content: bytes, target: str, job: str) -> tuple[int, str]:
    """Bytes and status (written or kept) of ``content`` at ``target``, whole or not at all; what stands with its size is kept."""
    store, place = fs.FileSystem.from_uri(target)
    there = store.get_file_info(place)
    if there.type == fs.FileType.File and there.size == len(content):
        return len(content), "kept"
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = attempt_name(place, job)
    with store.open_output_stream(part) as out:
        out.write(content)
    if there.type == fs.FileType.File:
        store.delete_file(place)
    store.move(part, place)
    return len(content), "written"


def _link(source: str, target: str) -> tuple[int | None, str]:
    """A link on disks that all tasks share; the links made by two attempts are one."""
    try:
        one, other = source.removeprefix("file://"), target.removeprefix("file://")
        if not os.path.isfile(one):
            return None, "missing"
        os.makedirs(os.path.dirname(other), exist_ok=True)
        try:
            os.symlink(os.path.abspath(one), other)
            return os.path.getsize(one), "linked"
        except FileExistsError:
            return os.path.getsize(other) if os.path.isfile(other) else None, "kept"
    except OSError:
        return None, "failed"


def materialise(manifest: DataFrame, folder: str, how: str = "copy", job: str | None = None) -> DataFrame:
    """source, target, length, status of each target of ``manifest`` (source, target below ``folder``), once all stand.

    Of several sources of one target the first by name is taken; rows with a null are left out. The result is the manifest
    that was written to ``folder``/_manifest-<job>; a job that has one isn't done again.
    """
    if how not in ("copy", "link"):
        raise ValueError(f"how is copy or link, not {how}")
    spark, job = manifest.sparkSession, job or uuid.uuid4().hex
    at = f"{folder.rstrip('/')}/_manifest-{job}"
    store, place = fs.FileSystem.from_uri(at)
    if store.get_file_info(f"{place}/_SUCCESS").type == fs.FileType.File:
        return spark.read.schema(SCHEMA).parquet(at)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [(s, t, *(_copy(s, t, job) if how == "copy" else _link(s, t))) for s, t in zip(pdf["source"], pdf["target"], strict=True)]
            yield pd.DataFrame(out, columns=["source", "target", "length", "status"]).astype({"length": "Int64"})

    rows = manifest.where("source IS NOT NULL AND target IS NOT NULL").groupBy("target").agg(F.min("source").alias("source"))
    rows.select("source", "target").mapInPandas(run, SCHEMA).write.mode("overwrite").parquet(at)
    clean_up(folder, job)
    return spark.read.schema(SCHEMA).parquet(at)


def clean_up(folder: str, job: str) -> int:
    """Removes what dead attempts of a job left below ``folder``; returns how many files that were."""
    store, inside = fs.FileSystem.from_uri(folder)
    mark, n = f".{job}.", 0
    for f in store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True)):
        if f.type == fs.FileType.File and mark in f.base_name and f.base_name.endswith(".part"):
            store.delete_file(f.path)
            n += 1
    return n
