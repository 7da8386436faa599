"""The pipeline stage by stage against the operators' brute-force rules."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .test_documents import brute_lines, brute_near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "mix", "tokenize"]
    graded = stages["quality"](spark, docs, SF)
    kept = graded.toPandas()
    assert graded.columns == docs.columns and 0 < len(kept) < docs.count()
    lined = stages["lines"](spark, graded, SF)
    have = {r.doc_id: r.text for r in lined.collect()}
    want = {i: t for i, (n, t) in brute_lines([(r.doc_id, r.text) for r in kept.itertuples() if r.text is not None]).items() if not n or t.split()}
    assert {i: t for i, t in have.items() if t is not None} == want
    near = stages["near_duplicates"](spark, lined, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, x in brute_near(list(have.items())).items() if x[2])
    mixed = stages["mix"](spark, near, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    out = stages["tokenize"](spark, mixed, SF)
    assert out.count() == mixed.count() and sorted(r.text for r in out.collect()) == sorted(r.text or "" for r in mixed.collect())


def test_run_gives_the_same_rows_twice(spark):
    first, second = (sorted((r.doc_id, r.n_pieces, r.text) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first


def test_stages_on_odd_rows(spark):
    """Null and empty texts, null ids and repeated rows pass every stage; no stage fails on an empty table."""
    import random

    rnd = random.Random(1)
    text = "\n".join(" ".join(rnd.choice("abcdefgh") * rnd.randrange(3, 9) for _ in range(20)) for _ in range(4))
    rows = [(1, text, None, "s", None), (1, text, None, "s", None), (2, None, None, None, 0), (3, "", "x", "s", 0), (None, "own words", None, "t", 9), (4, text, None, "t", 1), (5, "x" * 100_000, None, "t", 5), (6, "▁ 字 \n\n", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        now, counts = start, []
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            counts.append(now.count())
            assert name == "tokenize" or now.columns == corpus_pipeline.COLUMNS
        assert counts == [0] * 5 if start is not docs else counts[0] >= 6
        assert start is not docs or {2, 3} <= {r.doc_id for r in stage_rows(spark, docs)}


def test_rows_without_id_that_copy_an_identified_document_go(spark):
    """(null, T) is a copy of (1, T) and goes, though another row without id stays; of repeated rows one stays."""
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"x{k}" for k in range(40))
    rows = [(1, text, "la", "s", 3), (None, text, "la", "s", 3), (None, other, "la", "s", 4), (None, other, "la", "r", 4), (7, other[:9], None, None, None), (7, other[:12], None, "s", 1), (8, None, None, "s", 0), (8, None, None, None, 0)]
    docs = spark.createDataFrame(rows + [(None, other, "la", "s", 4)] * 300, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = sorted((repr(r.doc_id), repr(r.text), repr(r.source)) for r in stage(spark, docs, SF).collect())
    assert got == sorted([("1", repr(text), "'s'"), ("None", repr(other), "'r'"), ("7", repr(other[:9]), "None"), ("7", repr(other[:12]), "'s'"), ("8", "None", "None")])


def stage_rows(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    return stages["near_duplicates"](spark, stages["lines"](spark, docs, SF), SF).collect()
