"""Session helpers: the folder that driver and executors share, and checkpoints in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return SparkSession.builder.master(f"local[{cpus}]").appName("tagmill").config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names none, local mode (tests) gets a temporary folder and a cluster one in its warehouse.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(found or (tempfile.mkdtemp(prefix="tagmill-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read from there: lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
