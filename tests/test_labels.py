"""Label readers, resolution and the audit on small tables."""

from __future__ import annotations

from tagmill.operators import labels as L
from tagmill.operators import profile as P
from tagmill.operators import resolve as R
from tagmill.schemas import LABEL_LINES

LINES = [
    "0 0.5 0.5 0.2 0.2", "", "1 0.5 0.5 0.2", "1 0.5 0.5 0.2 0.2 0.9", "x 0.5 0.5 0.2 0.2", "1.5 0.5 0.5 0.2 0.2", "-1 0.5 0.5 0.2 0.2", "7 0.5 0.5 0.2 0.2", "0 1.2 0.5 0.2 0.2",
    "0 0.5 0.5 0 0.2", "0 0.95 0.5 0.2 0.2", "0 0.5 0.5 0.01 0.01", "0 0.500000 0.5 0.2 0.2", "2.0 0.5 0.5 0.2 0.2", "0 0.5 0.5 5d 0.2", "0 nan 0.5 0.2 0.2", "0 1_0 0.5 0.2 0.2", "9 2.0 0.5 0.2 0.2",
]


def lines(spark, rows=LINES):
    return spark.createDataFrame([("a", i, t) for i, t in enumerate(rows, 1)], LABEL_LINES)


def test_strict_rules(spark):
    rows = {r.line_no: r for r in L.parse_strict(lines(spark), 3, 0.0002).collect()}
    assert 2 not in rows
    errors = {n: list(r.errors) for n, r in rows.items() if r.errors}
    assert errors == {
        3: ["columns"], 5: ["not a number"], 6: ["class id"], 7: ["class id"], 8: ["class range"], 9: ["coordinates"], 10: ["empty box"],
        15: ["not a number"], 16: ["not a number"], 17: ["not a number"], 18: ["class range", "coordinates"],
    }
    warns = {n: list(r.warns) for n, r in rows.items() if r.warns}
    assert warns == {4: ["confidence column"], 11: ["leaves image"], 12: ["tiny"], 13: ["repeated"]}
    assert sorted(n for n, r in rows.items() if r.kept) == [1, 4, 8, 11, 12, 13, 14]
    assert rows[14].cls == 2


def test_readers_differ(spark):
    df = lines(spark)
    lenient = {r.line_no: r.cls for r in L.parse_lenient(df).collect()}
    assert lenient[6] == 1 and lenient[7] == -1 and lenient[4] == 1 and 10 not in lenient and 3 not in lenient
    editor = {r.line_no for r in L.parse_editor(df, 640, 480).collect()}
    assert 4 not in editor and 14 not in editor and 1 in editor
    merged = {r.line_no: (r.src_cls, r.rest) for r in L.parse_merge(df).collect()}
    assert merged[4] == (1, "0.5 0.5 0.2 0.2 0.9") and merged[5][0] is None and merged[14] == (2, "0.5 0.5 0.2 0.2")


def test_inferred_classes(spark):
    boxes = spark.createDataFrame([(2,), (0,)], "cls int")
    assert [r.name for r in L.infer_classes(boxes).orderBy("cls").collect()] == ["class_0", "class_1", "class_2"]
    assert L.infer_classes(boxes.limit(0)).count() == 0


def test_audit_of_missing_and_empty_labels(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "image_id string")
    parsed = L.parse_strict(spark.createDataFrame([("a", 1, "0 0.5 0.5 0.2 0.2"), ("b", 1, "")], LABEL_LINES), 3)
    labels = spark.createDataFrame([("a",), ("b",)], "image_id string")
    rows = {r.image_id: (r.has_label, r.n_boxes, r.n_warns, r.mark) for r in P.audit(images, labels, parsed).collect()}
    assert rows == {"a": (True, 1, 0, "✓"), "b": (True, 0, 1, "?"), "c": (False, 0, 1, "○")}


def test_candidate_order(spark):
    images = spark.createDataFrame([(1, "/d/x/a.jpg"), (2, "/d/x/b.jpg"), (3, "/d/x/c.jpg")], "image_id int, path string")
    labels = spark.createDataFrame([("/d/x/a.txt", 5), ("/d/x/labels/a.txt", 5), ("/d/labels/x/b.txt", 0), ("/d/labels/b.txt", 3)], "path string, length long")
    rows = {r.image_id: (r.label_path, r.rank) for r in R.by_candidates(images, labels, "/d").collect()}
    assert rows == {1: ("/d/x/a.txt", 1), 2: ("/d/labels/b.txt", 3), 3: (None, None)}


def test_a_line_is_split_once(spark):
    """A filter on a reading, and one column of it, don't compute the line's parts again."""
    for rows in (L.parse_strict(lines(spark), 3).where("kept").select("image_id").distinct(), L.parse_lenient(lines(spark)).where("cls < 50"), L.parse_editor(lines(spark), 640, 480)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert L.parse_strict(lines(spark), 3).where("kept").count() == 7


def test_label_lines_number_the_boxes_once(spark):
    """Lines that stand twice come from the same pass over the line items."""
    from tagmill.plans import labelling

    plan = labelling.label_lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_split_materials_audit_once(spark):
    from tagmill.plans import manifests

    plan = manifests.split_materials(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan


def test_audit_views_seek_copies_among_all_orders(spark, tmp_path):
    """Orders of every customer count as copies, in code and SQL; those without a customer or a price don't."""
    import duckdb

    from tagmill.plans import labelling

    from .oracle import same_rows

    orders = [(1, 1, 10.0), (2, 1, 20.0), (3, 2, 60000.0), (4, 2, 70000.0), (5, 3, 10.0), (6, 3, 20.0), (7, 4, 10.0), (8, 4, 60000.0), (9, None, 10.0), (10, None, 10.0), (11, 5, None), (12, 5, None)]
    spark.createDataFrame([(k, c, "F", p) for k, c, p in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    items.where("l_orderkey < 9").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = labelling.audit_filter_views(spark, str(tmp_path))
    counts = {r["view"]: r["n"] for r in rows.collect()}
    assert (counts["all"], counts["dup"]) == (12, 6)
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(rows, con, labelling.ORACLE["audit_filter_views"])
