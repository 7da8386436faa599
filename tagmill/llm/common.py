"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import cut as cut  # noqa: PLC0414  (shared by the operators)

#: A word, for Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` where it is set; else, in local mode only (tests), a temporary folder, and
    otherwise a folder in the warehouse.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("tagmill.checkpoint.dir", None)
    if not found:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="tagmill-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.conf.set("tagmill.checkpoint.dir", found)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own for ``name`` in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo(dict):
    """Results of ``make`` by key, in two generations of at most ``most`` keys.

    When the young generation is full it becomes the old one, and a key that is asked for again moves on: what is frequent
    stays. Keys longer than LONGEST are not remembered, so memory is bounded in bytes.
    """

    LONGEST = 64

    def __init__(self, make: Callable[[Any], Any], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: Any) -> Any:
        if len(key) > self.LONGEST:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out
