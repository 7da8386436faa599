"""Readers of label, COCO and VOC files, class names and image headers; sinks read back."""

from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagmill.operators import labels as L
from tagmill.operators import remap as R
from tagmill.operators import resolve
from tagmill.sinks import labels as K
from tagmill.sources import classes, coco, files, voc

CLASS_MAP = "source string, src_cls int, dst_cls int"


def png(w, h):
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", h, w) + b"\x01\x00\x00\x00"


@pytest.fixture
def dataset(tmp_path):
    for name, content in {
        "images/a.jpg": jpeg(200, 100), "images/sub/b.PNG": png(64, 32), "images/c.bmp": b"BM" + bytes(16) + struct.pack("<ii", 7, -9), "images/labels/d.png": b"no image", "images/n.txt": b"",
        "labels/a.txt": b"0 0.5 0.5 0.2 0.2\r\n1 0.5 0.5 0.1 0.1\n", "labels/sub/b.txt": b"2 0.5 0.5 0.2 0.2", "labels/empty.txt": b"", "labels/classes.txt": b"x\ny\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path


def test_listing_and_sizes(spark, dataset):
    root = str(dataset / "images")
    rows = {(r.rel_dir, r.stem, r.ext) for r in files.list_images(spark, root).collect()}
    assert rows == {("", "a", "jpg"), ("sub", "b", "png"), ("", "c", "bmp"), ("labels", "d", "png")}
    assert {r.stem for r in files.list_images(spark, root, skip_hidden=True).collect()} == {"a", "b", "c"}
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in files.image_sizes(spark, root).collect()}
    assert sizes == {"a.jpg": (200, 100), "b.PNG": (64, 32), "c.bmp": (7, 9), "d.png": (0, 0)}


def test_sizes_of_other_formats(spark, tmp_path):
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 640) + struct.pack("<HHIHH", 257, 3, 1, 480, 0)
    big = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 32, 0) + struct.pack(">HHII", 257, 4, 1, 16)
    riff = lambda kind, data: b"RIFF" + bytes(4) + b"WEBP" + kind + bytes(4) + data + bytes(20)
    late = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 40_002) + bytes(40_000)) * 3 + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 11, 22) + bytes(9)
    far = b"II*\0" + struct.pack("<I", 100_000) + bytes(99_992) + tiff[8:]
    for name, content in {
        "a.tif": tiff, "b.tiff": big, "c.webp": riff(b"VP8X", bytes(4) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")), "d.webp": riff(b"VP8L", b"\x2f" + (7 | 8 << 14).to_bytes(4, "little")),
        "e.webp": riff(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 320, 240)), "f.jpg": late, "g.tif": far, "h.webp": b"RIFF", "i.tif": b"II*\0" + bytes(4),
    }.items():
        (tmp_path / name).write_bytes(content)
    sizes = {r.path[-6:]: (r.width, r.height) for r in files.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"/a.tif": (640, 480), "b.tiff": (32, 16), "c.webp": (100, 50), "d.webp": (8, 9), "e.webp": (320, 240), "/f.jpg": (22, 11), "/g.tif": (640, 480), "h.webp": (0, 0), "/i.tif": (0, 0)}


def test_label_files(spark, dataset):
    lines = files.read_label_lines(spark, str(dataset / "labels"))
    rows = {(r.rel_dir, r.stem, r.line_no, r.line) for r in lines.where("line <> ''").collect()}
    assert ("", "a", 2, "1 0.5 0.5 0.1 0.1") in rows and ("sub", "b", 1, "2 0.5 0.5 0.2 0.2") in rows
    labels = files.list_labels(spark, str(dataset / "labels"))
    assert {r.stem: r.length for r in labels.collect()}["empty"] == 0
    images = files.list_images(spark, str(dataset / "images"))
    found = resolve.flat_then_nested(images, labels)
    assert {r.stem: bool(r.label_path) for r in found.collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert [r.stem for r in resolve.orphans(labels, images).collect()] == ["empty"]
    boxes = L.parse_strict(lines.where("stem <> 'classes'").withColumn("image_id", F.col("stem")), 3)
    assert boxes.where("kept").count() == 3


def test_names(spark, tmp_path):
    assert classes.parse_names("nc: 2\nnames: [a, 'b']\n") == {0: "a", 1: "b"}
    assert classes.parse_names("names:\n  0: a\n  3: \"b c\"\nnc: 2\n  5: z\n") == {0: "a", 3: "b c"}
    assert classes.parse_names("names:\n- a\n- b\n") == {0: "a", 1: "b"}
    assert classes.parse_names("nc: 1\n") == {}
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "x.txt").write_text("")
    (tmp_path / "classes.txt").write_text("u\n\nv\n")
    assert classes.load_names(spark, str(tmp_path / "images")) == {0: "u", 1: "v"}
    assert classes.names_table(spark, {1: "v"}, "s").collect()[0].asDict() == {"source": "s", "cls": 1, "name": "v"}


def test_files_of_names_in_their_order(spark, tmp_path):
    """A folder's description counts before its lists; each list is read if nothing before it names a class."""
    for name, text, want in (("_darknet.labels", "d\n", "d"), ("obj.names", "o\n", "o"), ("classes.txt", "c\n", "c"), ("data.yml", "names: [m]\n", "m"), ("data.yaml", "names: [y]\n", "y")):
        (tmp_path / name).write_text(text)
        assert classes.load_names(spark, str(tmp_path)) == {0: want}
    (tmp_path / "data.yaml").write_text("nc: 0\n")
    assert classes.load_names(spark, str(tmp_path)) == {0: "m"}


def test_descriptions():
    text = "# a set\npath: /d\ntrain: images/train\nval:\n  - a.txt\n  - 'b.txt'\nnames:\n  0: x\n  7: 'y z'\n  8:\nnc: 3\n"
    assert classes.read_description(text) == {"path": "/d", "train": "images/train", "val": ["a.txt", "b.txt"], "names": {"0": "x", "7": "y z", "8": None}, "nc": "3"}
    assert classes.parse_names(text) == {0: "x", 7: "y z"} and classes.read_description("- a\n") == {} and classes.parse_names("") == {}


def test_large_lists_of_names_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "classes.txt").write_text("\n".join(f"a class called {i}" for i in range(100_000)))
    assert len(classes.load_names(spark, str(tmp_path / "none"), str(tmp_path))) == 100_000
    monkeypatch.setattr(classes, "MOST_BYTES", 1000)
    with pytest.raises(ValueError):
        classes.load_names(spark, str(tmp_path))


def test_folders_of_a_dataset(spark, tmp_path):
    for name in ("a/img", "a/image", "a/etiketler", "b", "c/Images", "c/labels", "d/labels", "e/.hidden", "e/x/y", "e/z"):
        (tmp_path / name).mkdir(parents=True)
    root = str(tmp_path)
    assert classes.dataset_folders(spark, f"{root}/a") == (f"{root}/a/image", f"{root}/a/etiketler")
    assert classes.dataset_folders(spark, f"{root}/b") == (f"{root}/b", f"{root}/b")
    assert [classes.label_folder(spark, f"{root}/{x}") for x in ("c/Images/", "d", "b")] == [f"{root}/c/labels", f"{root}/d/labels", f"{root}/b"]
    for name in ("e/.hidden/data.yaml", "e/x/y/data.yaml", "e/z/data.yml", "e/x/y/other.yaml"):
        (tmp_path / name).write_text("names: [a]")
    assert classes.find_description(spark, f"{root}/e") == f"{root}/e/x/y/data.yaml"
    (tmp_path / "b" / "n.txt").write_text("x")
    assert classes.find_description(spark, f"{root}/b") is None


def test_coloured_classes_round_trip(spark, tmp_path):
    named = [("çelik", (1, 2, 3)), ("b", (255, 0, 9))]
    (tmp_path / classes.CLASS_FILE).write_text(classes.coloured_json(named))
    assert classes.load_coloured(spark, str(tmp_path / "none.json"), str(tmp_path)) == named
    assert classes.load_coloured(spark, str(tmp_path / "none")) == []


def test_format_by_folder(spark, tmp_path):
    for name in ("a/x.json", "a/y.json", "b/c/x.xml", "d/x.json", "d/y.xml", "e/t.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    assert [voc.guess_format(spark, str(tmp_path / x)) for x in ("", "b", "d", "e")] == ["coco", "voc", "voc", ""]


def test_split_entries(spark, dataset):
    (dataset / "train.txt").write_text("/x/1.jpg\n\n/x/2.jpg\n")
    assert classes.resolve_split(spark, None, str(dataset)).count() == 0
    paths = [r.path for r in classes.resolve_split(spark, ["train.txt", "images/sub"], str(dataset)).collect()]
    assert len(paths) == 3 and {"/x/1.jpg", "/x/2.jpg"} < set(paths)


COCO = {
    "images": [{"id": 1, "file_name": "a.jpg", "width": 200, "height": 100}, {"id": 2, "filename": "b.jpg", "width": 200, "height": 100}, {"id": 3, "width": 5, "height": 5}],
    "categories": [{"id": 7, "name": "lorry"}, {"id": 9, "name": "wagon"}, {"id": 11}],
    "annotations": [
        {"image_id": 1, "category_id": 7, "bbox": [50, 25, 100, 50], "iscrowd": 0}, {"image_id": 2, "category_id": 9, "bbox": [180, 80, 60, 60]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 5, 5], "iscrowd": 1},
        {"image_id": 99, "category_id": 9, "bbox": [0, 0, 5, 5]}, {"image_id": 1, "category_id": 9, "bbox": [0, 0, 5]}, {"image_id": 3, "category_id": 9, "bbox": [0, 0, 5, 5]}, {"category_id": 9, "bbox": [0, 0, 5, 5]},
    ],
}


def test_coco(spark, tmp_path):
    for name, text in {"a.json": json.dumps(COCO), "b.json": "{}", "c.json": "{ broken json"}.items():
        (tmp_path / name).write_text(text)
    found = coco.read_coco(spark, str(tmp_path))
    assert {(r.cls, r.name) for r in coco.classes_of(found).collect()} == {(7, "lorry"), (9, "wagon"), (11, "11")}
    raw = coco.boxes_of(coco.images_of(found), coco.annotations_of(found))
    assert raw.count() == 3
    class_map = spark.createDataFrame([("s", 7, 0), ("s", 9, 1)], CLASS_MAP)
    done = R.import_boxes(raw.withColumn("source", F.lit("s")), class_map, F.col("width").cast("double"), F.col("height").cast("double"))
    boxes = {r.path: tuple(round(v, 6) for v in (r.cx, r.cy, r.nw, r.nh)) for r in done.where("reason = 'box'").collect()}
    assert boxes == {"a.jpg": (0.5, 0.5, 0.5, 0.5), "b.jpg": (0.95, 0.9, 0.1, 0.2)}
    images = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True)], "image_id long, exists boolean, has_size boolean")
    counts = R.import_counts(images, done).first().asDict()
    assert counts == {"images": 2, "missing": 1, "boxes": 2, "clipped": 1, "flagged": 1, "unmapped": 0, "invalid": 0, "skipped_empty": 0}


VOC = """<annotation><filename>{name}</filename><size><width>200</width><height>100</height><depth>3</depth></size>
<object><name>trailer</name><difficult>0</difficult><bndbox><xmin>50</xmin><ymin>25</ymin><xmax>150</xmax><ymax>75</ymax></bndbox></object>
<object><name>lorry</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>5</ymax></bndbox></object></annotation>"""


def test_voc(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text(VOC.format(name="a.jpg"))
    (tmp_path / "sub" / "b.xml").write_text(VOC.format(name="").replace("trailer", "wagon"))
    found = voc.read_voc(spark, str(tmp_path))
    assert [(r.cls, r.name) for r in voc.classes_of(found).orderBy("cls").collect()] == [(0, "trailer"), (1, "lorry"), (2, "wagon")]
    rows = {(r.image_id, r.src_cls): (r.x, r.y, r.w, r.h, r.flagged) for r in voc.boxes_of(found).collect()}
    assert rows[("a.jpg", 0)] == (50.0, 25.0, 100.0, 50.0, False) and rows[("b.jpg", 1)][4] is True
    assert voc.guess_format(spark, str(tmp_path)) == "voc"


def test_merge_of_two_sources(spark):
    """Two datasets whose ids collide; one class is left out in a second run."""
    lines = [("A", f"a{i}", 1, f"{i % 2} 0.5 0.5 0.2 0.3") for i in range(6)] + [("B", f"b{i}", 1, f"{i % 2} 0.5 0.5 0.2 0.3") for i in range(4)]
    df = L.parse_merge(spark.createDataFrame([x[1:] for x in lines], "image_id string, line_no int, line string")).withColumn("source", F.upper(F.substring("image_id", 1, 1)))
    images = df.select("source", "image_id")
    named = spark.createDataFrame([("A", 0, 0, "lorry"), ("A", 0, 1, "wagon"), ("B", 1, 0, "wagon"), ("B", 1, 1, "trailer")], "source string, source_no int, cls int, name string")
    target = R.ordered_union(named)
    assert [r.name for r in target.orderBy("cls").collect()] == ["lorry", "wagon", "trailer"]
    merged = R.merge_lines(df, R.auto_map(named, target))
    assert {r.c: r.n for r in merged.groupBy(F.substring("line", 1, 1).alias("c")).agg(F.count("*").alias("n")).collect()} == {"0": 3, "1": 5, "2": 2}
    dropped = R.auto_map(named, target).withColumn("dst_cls", F.when(F.col("dst_cls") < 2, F.col("dst_cls")))
    rows = {r.source: (r.images, r.boxes, r.dropped, r.skipped_empty) for r in R.merge_counts(images, R.merge_lines(df, dropped)).collect()}
    assert rows == {"A": (6, 6, 0, 0), "B": (2, 2, 2, 2), None: (8, 8, 2, 2)}


def test_label_text_has_the_digits_of_c(spark):
    rows = [("a", 0, 1, 5e-7, 0.1234565, 0.5, 0.25)]
    boxes = spark.createDataFrame(rows, "image_id string, box_no int, cls int, cx double, cy double, w double, h double")
    images = spark.createDataFrame([("a",), ("b",)], "image_id string")
    texts = {r.image_id: r.text for r in K.label_texts(images, boxes).collect()}
    assert texts == {"a": "1 %.6f %.6f %.6f %.6f\n" % rows[0][3:], "b": ""}


def test_label_files_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.2\n"), ("b", "")], "stem string, text string")
    assert K.write_label_files(texts, f"file://{tmp_path}/labels").count() == 2
    lines = files.read_label_lines(spark, str(tmp_path / "labels"))
    assert {(r.stem, r.line) for r in lines.where("line <> ''").collect()} == {("a", "0 0.5 0.5 0.2 0.2")}
    assert {r.stem for r in files.list_labels(spark, str(tmp_path / "labels")).collect()} == {"a", "b"}


def test_lists_and_description(spark, tmp_path):
    rows = spark.createDataFrame([("/x/a.jpg", "train"), ("/x/b.jpg", "val")], "path string, split string")
    K.write_split_lists(rows, str(tmp_path / "lists"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lists" / "split=val")).collect()] == ["/x/b.jpg"]
    assert classes.parse_names(K.dataset_yaml("/d", ["a", "b"])) == {0: "a", 1: "b"}
    K.write_description(spark, str(tmp_path / "d"), "/d", ["a", "b"])
    assert spark.read.text(str(tmp_path / "d" / "classes")).count() == 2


def test_repaired_description(spark, dataset):
    root = str(dataset)
    exists = lambda p: classes.path_exists(spark, p)
    assert classes.repaired_parts({"train": "../images", "val": "no/such", "test": None}, root, exists) == {k: f"{root}/images" for k in ("train", "val", "test")}
    assert classes.repaired_parts({"train": f"{root}/images", "val": "labels"}, root, exists)["val"] == f"{root}/labels"
    assert classes.repaired_parts({"val": "nowhere"}, root, exists) == {}
    some = {"/d/in/a", "/d/a", "/e", "/x/y"}
    cases = [("a", "/d/in/a"), ("../a", "/d/a"), ("../../q/../in/a", None), ("../../../y", None), ("/e", "/e"), ("/none", None), ("../in/a", "/d/in/a"), ("./a/", "/d/in/a"), ("../../a", "/d/in/a"), ("", None)]
    for entry, want in cases:
        assert classes.repaired_parts({"val": entry}, "/d/in", some.__contains__) == ({"val": want} if want else {}), entry
