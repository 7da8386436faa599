"""Raw frames by ranges and strides, and facts of video containers made byte by byte."""

from __future__ import annotations

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from tagmill.sources import containers, frames


def y4m(path, n, w=6, h=4, rate="25:1", colour="420jpeg", tail=b""):
    size = {"420jpeg": 2 * -(-w // 2) * -(-h // 2), "mono": 0, "444": 2 * w * h, "422": 2 * -(-w // 2) * h}[colour]
    body = b"".join(b"FRAME\n" + bytes((k * 7 + p) % 256 for p in range(w * h)) + bytes(size) for k in range(n))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{colour}\n".encode() + body + tail)


@pytest.fixture
def clips(spark, tmp_path):
    frames.register(spark)
    y4m(tmp_path / "a.y4m", 40)
    y4m(tmp_path / "sub/b.y4m", 23, 5, 3, "30000:1001", "mono", b"FRAME\nxy")  # cut off within a frame
    y4m(tmp_path / "sub/c.Y4M", 3, 5, 3, "10:1", "444")
    (tmp_path / "empty.y4m").write_bytes(b"")
    (tmp_path / "other.y4m").write_bytes(b"RIFF")
    return tmp_path


def test_frames_and_strides_against_sql(spark, clips):
    every = spark.read.format("rawframes").load(str(clips)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.frame_no) for r in every} == {(n, k) for n, c in (("a.y4m", 40), ("b.y4m", 23), ("c.Y4M", 3)) for k in range(c)}
    assert all(r.grey == bytes((r.frame_no * 7 + p) % 256 for p in range(r.width * r.height)) for r in every)
    assert {r.ts_ms for r in every if r.path.endswith("b.y4m") and r.frame_no == 3} == {3000 / (30000 / 1001)}
    con = duckdb.connect()
    con.execute("CREATE TABLE frames (path VARCHAR, frame_no BIGINT)")
    con.executemany("INSERT INTO frames VALUES (?, ?)", [(r.path, r.frame_no) for r in every])
    for start, end, stride in ((0, 1 << 40, 1), (0, 1 << 40, 5), (3, 20, 4), (39, 40, 7), (50, 60, 1)):
        got = spark.read.format("rawframes").option("start", start).option("end", end).option("stride", stride).load(str(clips)).select("path", "frame_no").collect()
        assert sorted(map(tuple, got)) == con.execute(f"SELECT path, frame_no FROM frames WHERE frame_no >= {start} AND frame_no < {end} AND (frame_no - {start}) % {stride} = 0 ORDER BY ALL").fetchall()


def test_filters_take_partitions_away(spark, clips):
    rows = spark.read.format("rawframes").option("stride", 2).option("frames_each", 5).load(str(clips))
    assert rows.rdd.getNumPartitions() == 4 + 3 + 1
    some = rows.where((F.col("frame_no") > 20) & (F.col("frame_no") <= 26) & (F.col("path") == f"{clips}/a.y4m"))
    assert some.rdd.getNumPartitions() == 1 and [r.frame_no for r in some.orderBy("frame_no").collect()] == [22, 24, 26]
    tested = [x for x in some._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in x and "isnotnull" not in x.replace("isnotnull(frame_no", "").replace("isnotnull(path", "")]
    assert not any("> 20" in x or "<= 26" in x for x in tested)
    assert rows.where("frame_no = 7").count() == 0 and rows.where("frame_no = 8 AND width = 6").count() == 1
    assert rows.where("frame_no >= 100").count() == 0 and rows.where("frame_no % 3 = 0 AND frame_no < 10").count() == 2 * 2 + 1


def test_no_pixels_strict_and_single_files(spark, clips):
    bare = spark.read.format("rawframes").option("pixels", "false").load(f"{clips}/a.y4m")
    assert bare.count() == 40 and bare.where("grey IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="raw video"):
        spark.read.format("rawframes").option("strict", "true").load(str(clips)).count()
    y4m(clips / "bad/d.y4m", 2, tail=b"FRAME Ip\n" + bytes(100))
    with pytest.raises(Exception, match="frame 2"):
        spark.read.format("rawframes").load(f"{clips}/bad").collect()


def test_frames_become_images(spark, clips):
    from tagmill.sinks import images
    from tagmill.sources import pixels

    rows = spark.read.format("rawframes").option("stride", 10).load(str(clips))
    got = {r.target: r for r in images.write_frames(rows, f"{clips}/out", job="j").collect()}
    assert sorted(t.split("/out/")[1] for t in got) == [f"a/kare_0000{k}.png" for k in (1, 2, 3, 4)] + [f"b/kare_0000{k}.png" for k in (1, 2, 3)] + ["c/kare_00001.png"]
    for target, r in got.items():
        image = pixels.decode(open(target, "rb").read())
        assert image.tobytes() == bytes((r.frame_no * 7 + p) % 256 for p in range(image.size)) and r.status == "written"
    assert {r.status for r in images.write_frames(rows, f"{clips}/out", job="k").collect()} == {"kept"}


def test_ranges_and_strides():
    assert [frames.stride_of(25, s) for s in (0, 5, 10, 100)] == [1, 5, 2, 1]
    assert frames.frame_range(None, 5, 25, 75) == (0, 75) and frames.frame_range(0, 2000, 25, 75) == (0, 50)
    assert frames.frame_range(1000, 9000, 25, 75) == (25, 75) and frames.frame_range(5000, 4000, 25, 75) == (0, 75) and frames.frame_range(None, None, 25, 0)[1] == frames.ENDLESS


def box(kind, *content, wide=False):
    body = b"".join(content)
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), kind) + body


def clock(kind, scale, units, version=0):
    return box(kind, bytes([version, 0, 0, 0]), struct.pack(">QQIQ", 0, 0, scale, units) if version else struct.pack(">IIII", 0, 0, scale, units), bytes(80))


def track(kind, scale, units, times, w=0, h=0, version=0):
    stts = box(b"stts", bytes(4), struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times))
    media = box(b"mdia", clock(b"mdhd", scale, units, version), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stsd", bytes(8)), stts)))
    return box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", w << 16, h << 16)), media)


def test_container_facts(spark, tmp_path):
    head, media = box(b"ftyp", b"isom", bytes(4)), box(b"mdat", bytes(5000))
    video, sound = track(b"vide", 12800, 38400, [(75, 512)], 320, 240), track(b"soun", 44100, 132300, [(130, 1024)])
    odd = track(b"vide", 90000, 270270, [(60, 3003), (30, 3003)], 1920, 1080, 1)
    files = {
        "front.mp4": head + box(b"moov", clock(b"mvhd", 1000, 3000), video, sound) + media,
        "end.MOV": head + box(b"mdat", bytes(70000), wide=True) + box(b"free") + box(b"moov", clock(b"mvhd", 600, 1802, 1), odd),
        "sound.m4v": head + box(b"moov", clock(b"mvhd", 1000, 0), sound) + media,
        "cut.mp4": head + struct.pack(">I4s", 9999, b"moov") + bytes(20),
        "none.mp4": head + media,
        "text.mp4": b"this is no video at all",
        "empty.mp4": b"",
        "zero.mp4": head + struct.pack(">I4s", 0, b"moov") + clock(b"mvhd", 1000, 500),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r for r in containers.video_facts(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    front, end, only, zero = (got[n] for n in ("front.mp4", "end.MOV", "sound.m4v", "zero.mp4"))
    assert (front.duration_ms, front.fps, front.frames, front.width, front.height, front.has_video, front.has_audio) == (3000, 25.0, 75, 320, 240, True, True)
    assert (end.duration_ms, end.frames, end.width, end.has_audio) == (3003, 90, 1920, False) and end.fps == pytest.approx(30000 / 1001)
    assert (only.duration_ms, only.fps, only.has_video, only.has_audio) == (3000, None, False, True)
    assert (zero.readable, zero.duration_ms, zero.has_video) == (True, 500, False)
    assert all(not got[n].readable and got[n].duration_ms is None for n in ("cut.mp4", "none.mp4", "text.mp4", "empty.mp4"))


def test_only_the_table_of_contents_is_read():
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.read_bytes += n
            self.at += n
            return self.data[self.at - n : self.at]

    moov = box(b"moov", clock(b"mvhd", 1000, 3000))
    file = Counted(box(b"ftyp", bytes(8)) + box(b"mdat", bytes(1 << 20)) + moov)
    assert containers.facts(containers.read_moov(file, len(file.data)))["duration_ms"] == 3000 and file.read_bytes < 300
