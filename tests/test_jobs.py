"""Files put in place by tasks that may die, work that is cancelled, and chains whose frames arrive in any order."""

from __future__ import annotations

import os
import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagmill.operators import partial
from tagmill.sinks import files
from tagmill.streaming import chains


def manifest(spark, rows):
    return spark.createDataFrame([(s, t, 1) for s, t in rows], "source string, target string, length int")


@pytest.fixture
def sources(tmp_path):
    out = []
    for k in range(12):
        p = tmp_path / "in" / f"{k}.jpg"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(bytes([k]) * (1000 * k))
        out.append(str(p))
    return out


def test_copies_stand_whole_and_once(spark, tmp_path, sources):
    out = f"{tmp_path}/out"
    rows = [(s, f"{out}/{'train' if k % 3 else 'val'}/images/{k}.jpg") for k, s in enumerate(sources)]
    more = [(sources[5], rows[4][1]), (f"{tmp_path}/in/none.jpg", f"{out}/val/images/none.jpg"), (None, f"{out}/x"), (sources[0], None)]
    os.makedirs(f"{out}/train/images")
    dead = files.attempt_name(rows[1][1], "j1")  # what an attempt that was killed left
    open(dead, "wb").write(b"half")
    foreign = files.attempt_name(rows[1][1], "other")
    open(foreign, "wb").write(b"x")
    open(rows[2][1], "wb").write(b"old")  # an older file of another size
    got = files.materialise(manifest(spark, rows + more).repartition(5), out, job="j1")
    assert {r.target: (r.status, r.length) for r in got.collect()} == {t: ("copied", os.path.getsize(s)) for s, t in rows} | {f"{out}/val/images/none.jpg": ("missing", None)}
    assert all(open(s, "rb").read() == open(t, "rb").read() for s, t in rows) and not os.path.exists(dead) and os.path.exists(foreign)
    again = files.materialise(manifest(spark, rows), out, job="j2")
    assert {r.status for r in again.collect()} == {"kept"}
    os.remove(rows[3][1])
    assert files.materialise(manifest(spark, rows), out, job="j2").count() == 12 and not os.path.exists(rows[3][1])  # a job that is whole isn't done again
    assert {r.status for r in files.materialise(manifest(spark, rows), out, job="j3").collect()} == {"kept", "copied"}


def test_a_job_that_died_is_finished(spark, tmp_path, sources, monkeypatch):
    """A task that fails in the middle leaves no manifest and no half a target; the next run ends with all files."""
    out = f"{tmp_path}/out"
    rows = [(s, f"{out}/{k}.jpg") for k, s in enumerate(sources)]
    os.makedirs(f"{out}/7.jpg")  # a folder stands where a file should: this copy fails
    got = {r.target: r.status for r in files.materialise(manifest(spark, rows), out, job="a").collect()}
    assert got[f"{out}/7.jpg"] == "failed" and sum(s == "copied" for s in got.values()) == 11
    os.rmdir(f"{out}/7.jpg")
    got = {r.target: r.status for r in files.materialise(manifest(spark, rows), out, job="b").collect()}
    assert got[f"{out}/7.jpg"] == "copied" and sum(s == "kept" for s in got.values()) == 11
    left = [f for _, _, names in os.walk(out) for f in names if f.endswith(".part")]
    assert left == [] and open(f"{out}/7.jpg", "rb").read() == open(sources[7], "rb").read()


def test_links_keep_what_is_there(spark, tmp_path, sources):
    out = f"{tmp_path}/links"
    os.makedirs(out)
    open(f"{out}/0.jpg", "wb").write(b"mine")
    rows = [(s, f"{out}/{k}.jpg") for k, s in enumerate(sources)]
    got = {r.target: r.status for r in files.materialise(manifest(spark, rows), out, "link").collect()}
    assert got[f"{out}/0.jpg"] == "kept" and open(f"{out}/0.jpg", "rb").read() == b"mine"
    assert all(os.path.islink(t) and os.path.samefile(s, t) for s, t in rows[1:])
    with pytest.raises(ValueError):
        files.materialise(manifest(spark, rows), out, "move")


def test_cancelled_work_gives_whole_slices(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), "id")

    def slow(part):
        def nap(parts):
            for pdf in parts:
                time.sleep(0.4 if len(pdf) else 0)
                yield pdf

        return part.mapInPandas(nap, "k long, id long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    whole = partial.Sliced(spark, 3).run(rows, "k", lambda part: part.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    assert not whole.cancelled and whole.done == (0, 1, 2) and {tuple(r) for r in whole.rows.collect()} == {(k, 10) for k in range(40)}
    job = partial.Sliced(spark, 10)
    stop = threading.Thread(target=lambda: (wait_for(lambda: os.path.exists(f"{job.folder.removeprefix('file:')}/slice-1/_SUCCESS")), job.cancel()))
    stop.start()
    got = job.run(rows, "k", slow)
    stop.join()
    assert got.cancelled and 2 <= len(got.done) < 10
    slice_of = {r.k: r.s for r in rows.select("k", F.pmod(F.xxhash64("k"), F.lit(10)).alias("s")).distinct().collect()}
    assert {tuple(r) for r in got.rows.collect()} == {(k, 10) for k, s in slice_of.items() if s in got.done}
    early = partial.Sliced(spark, 4)
    early.cancel()
    assert early.run(rows, "k", slow).done == () and spark.range(5).count() == 5  # later jobs run
    with pytest.raises(Exception, match="division|DIVIDE"):
        partial.Sliced(spark, 2).run(rows, "k", lambda part: part.select(F.expr("assert_true(id < 0, 'division')")))


def wait_for(what, seconds=30):
    end = time.monotonic() + seconds
    while not what() and time.monotonic() < end:
        time.sleep(0.05)


def plain_chains(rows, least=0.40):
    """Every frame of each chain in order, up to the first that is lost."""
    out = []
    for clip in {r[0] for r in rows}:
        n, alive = 0, True
        for _, _, frame, value in sorted({r for r in rows if r[0] == clip}, key=lambda r: (r[1], r[2])):
            if alive:
                n, alive = n + (value >= least), value >= least
                out.append((clip, frame, n, alive))
    return sorted(out)


def test_late_frames_are_taken_in_order(spark, tmp_path):
    """Frames dealt at random over files that arrive one by one: the same chains as if all had been sorted."""
    rng, rows = random.Random(4), []
    base = datetime(2024, 1, 1)
    for clip in ("a", "b", "c"):
        for k in range(20):
            rows.append((clip, base + timedelta(seconds=10 * k), k, 0.9 if clip == "a" or k < 13 else rng.choice([0.1, 0.9])))
    want = plain_chains(rows)
    rng.shuffle(rows)
    end = [("z", base + timedelta(hours=h), h, 0.5) for h in (5, 6)]  # moves the watermark past all
    late = [("a", base, 999, 0.0)]  # beyond any patience: left out
    parts = [rows[i::4] for i in range(4)] + [end[:1], late, end[1:], [("z", base + timedelta(hours=7), 7, 0.5)]]
    schema = "clip_id string, ts timestamp, frame_no long, likeness double"
    for i, part in enumerate([*parts, [rows[0]]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if i else 0)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        out = chains.ordered_chains(stream, late="30 minutes", idle_ms=1_800_000)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("clip_id <> 'z'").collect())
    assert got == want
    assert max(states) > 50 and states[-1] < 12  # nothing of the finished chains is left
