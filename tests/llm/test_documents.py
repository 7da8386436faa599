"""Mixing, repeated passages and near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagmill.llm import lines, minhash, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 1, "x") for i, t, s in rows], DOCS)


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_mix_reaches_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)] + [(None, "a b", None), (5000, None, None), (5001, "", "empty")]
    found = mixing.mix_sources(docs(spark, rows)).toPandas()
    assert len(found) == len(rows)
    assert (found["taken"] <= 3 * found["size"]).all()
    joined = found.merge(docs(spark, rows).select("doc_id", "source").toPandas(), on="doc_id")
    for _, part in joined.groupby("source", dropna=False):
        target, size = part["target"].iloc[0], part["source_size"].iloc[0]
        assert abs(part["taken"].sum() - target) <= 8 and target <= 3 * size + 1e-9
    again = mixing.mix_sources(docs(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert found.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def test_empty_texts_of_a_source_at_its_cap(spark):
    """A source at three times its size takes each of its documents three times, those of size 0 too."""
    rows = [(i, "w " * 10 if i % 2 else "", "a" if i < 20 else "b") for i in range(220)]
    found = mixing.mix_sources(docs(spark, rows)).collect()
    small = [r for r in found if r.source_size == 100]
    assert len(small) == 20 and {r.copies for r in small} <= {1, 2, 3}
    capped = mixing.mix_sources(docs(spark, rows), weights=(9, 1)).collect()
    assert {r.copies for r in capped if r.source_size == 100} == {3} and all(r.target == 300 for r in capped if r.source_size == 100)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert mixing.mix_sources(docs(spark, [(1, None, None)])).first().taken == 0


def test_mixed_rows_repeat_as_they_are_taken(spark):
    df = docs(spark, [(i, "w " * (i % 5), "ab"[i % 2]) for i in range(400)])
    plan = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(df).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in plan.items() if n}


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_mix", "_source", "_copies", "_round", "h", "row", "limit", "whole", "col", "copies"]
    df = spark.createDataFrame([(1, "a b", "s", *range(10)), (1, "a b", "s", *range(10)), (2, "c d", "t", *range(10))], ["doc_id", "text", "source", *names])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(10))}


def test_mix_of_ties_at_the_border(spark):
    """Rows of one id share a hash: all are taken, or none, also where the budget runs out."""
    df = docs(spark, [(i // 5, "w w", "ab"[i // 5 % 2]) for i in range(400)])
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == 400 and all(len({r.taken for r in rows if r.doc_id == i}) == 1 for i in range(80))


def brute_lines(rows, min_words=12):
    """The rule in plain Python: chunks of lines and shortest runs of 50 words, met before in the corpus, go."""
    import hashlib

    def spans(ls):
        of = [(p, x, len(x.split()), int(hashlib.md5(x.encode()).hexdigest()[:7], 16)) for p, x in enumerate(ls) if x.split()]
        out, start = set(), 0
        for i, (_, _, _, h) in enumerate(of):
            if i == len(of) - 1 or (h * 31 + (of[i - 1][3] if i else 0)) % 3 == 0:
                if i > start and sum(x[2] for x in of[start : i + 1]) >= min_words:
                    out.add((start, i))
                start = i + 1
            ends = [j for j in range(i, len(of)) if sum(x[2] for x in of[i : j + 1]) >= 50]
            begins = [j for j in range(i + 1) if sum(x[2] for x in of[j : i + 1]) >= 50]
            out |= {(i, min(ends))} if ends else set()
            out |= {(max(begins), i)} if begins else set()
        return [(of[s][0], of[e][0], "\n".join(x[1] for x in of[s : e + 1])) for s, e in sorted(out)]

    places: dict = {}
    for i, t in rows:
        for s, e, text in spans(t.split("\n")):
            places.setdefault(text, []).append((i, s, e))
    gone: dict = {i: set() for i, _ in rows}
    for found in places.values():
        first, *others = sorted(found)
        for i, s, e in others:
            if not (i == first[0] and s <= first[2]):
                gone[i] |= set(range(s, e + 1))
    return {i: (len(gone[i]), "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i])) for i, t in rows}


def test_line_dedup(spark):
    shared = ["\n".join(" ".join(words(5, 100 + k * 9 + j)) for j in range(8)) for k in range(3)] + [" ".join(words(60, 999))]
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        own = [" ".join(words(6, i * 50 + j)) for j in range(6)]
        own.insert(rnd.randrange(6), rnd.choice(shared))
        rows.append((i, "\n".join(own)))
    df = docs(spark, [(i, t, "s") for i, t in rows])
    found = {r.doc_id: (r._n_removed, r.text) for r in lines.dedup_chunks(df).collect()}
    assert found == brute_lines(rows)
    assert sum(n > 0 for n, _ in found.values()) >= 20
    assert all(shared[3] not in t for i, (_, t) in found.items() if i > 0 and shared[3] in dict(rows)[i] and any(shared[3] in dict(rows)[j] for j in range(i)))


def test_passages_go_whole(spark):
    """Passages of over 50 words in 2 to 20 short lines, between private lines: all lines go, and only those."""
    rows, passages = [], {}
    for k, (n, each) in enumerate([(2, 40), (3, 20), (5, 12), (6, 10), (10, 10), (20, 3), (2, 26), (60, 1)]):
        passage = [" ".join(words(each, 7000 + 100 * k + j)) for j in range(n)]
        for copy in range(4):
            private = [[" ".join(words(7, 100_000 + 1000 * k + 100 * copy + 10 * side + j)) for j in range(copy + 1)] for side in range(2)]
            if copy == 3:
                passage = [x for line in passage for x in (line, "")][:-1]  # the same lines with blank ones between
            rows.append((10 * k + copy, "\n".join(private[0] + passage + private[1])))
            passages[10 * k + copy] = (n, "\n".join(private[0] + private[1]))
    found = {r.doc_id: r.text for r in lines.dedup_chunks(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert all(found[i] == (dict(rows)[i] if i % 10 == 0 else alone) for i, (_, alone) in passages.items())


def test_repeats_within_a_document(spark):
    """A later copy in the same text goes; lines that repeat themselves keep the run they overlap."""
    passage, line = "\n".join(" ".join(words(30, j)) for j in range(3)), " ".join(words(26, 9))
    rows = [(1, f"{passage}\nown words here\n{passage}"), (2, "\n".join([line] * 3)), (3, "\n".join([line] * 5))]
    found = {r.doc_id: (r._n_removed, r.text) for r in lines.dedup_chunks(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert found == brute_lines(rows) and found[1] == (3, f"{passage}\nown words here") and found[3][1] == ""


def test_equal_hashes_of_different_bytes_stay(spark, monkeypatch):
    monkeypatch.setattr(lines.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 or isinstance(c[0], str) else F.lit(8).cast("long"))
    rows = [(i, " ".join(words(60, i)), "s") for i in range(4)]
    assert {r.doc_id: r.text for r in lines.dedup_chunks(docs(spark, rows)).collect()} == {i: t for i, t, _ in rows}


def test_many_rows_that_repeat(spark):
    """5,000 rows with the same null id and text are one document; the time grows with rows, not with their square."""
    import time

    text = "\n".join(" ".join(words(7, k)) for k in range(60))
    other = "\n".join([*(" ".join(words(9, 900 + k)) for k in range(5)), *text.split("\n")[10:40]])
    df = docs(spark, [(None, text, "s")] * 5000 + [(4, other, "s"), (4, text[:200], "t"), (4, other, "s")])
    start = time.monotonic()
    got = lines.dedup_chunks(df).groupBy("doc_id", F.md5("text").alias("m"), "_n_removed").count().collect()
    assert time.monotonic() - start < 60
    assert sorted((r.doc_id or 0, r._n_removed, r["count"]) for r in got) == [(0, 0, 5000), (4, 0, 1), (4, 30, 2)]


def test_two_texts_of_one_id(spark, tmp_path):
    """Where one id has several texts, code and SQL keep the same occurrence."""
    import duckdb

    from ..oracle import same_rows

    shared = [" ".join(words(60, 700 + k)) for k in range(3)]
    rows = [(i // 3 if i % 7 else None, "\n".join([*(f"own {i} {j}" for j in range(i % 4)), shared[i % 3], shared[(i + 1) % 3]]), "s") for i in range(40)]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same_rows(lines.op7_line_dedup(spark, str(tmp_path)), con, lines.ORACLE["op7_line_dedup"])


def test_line_dedup_odd_rows(spark):
    text = "\n".join(" ".join(words(8, k)) for k in range(9))
    df = docs(spark, [(1, text, "a"), (1, text, "b"), (2, None, "a"), (3, "", "a"), (4, "x" * 200000, "a"), (None, "\n\n", "a"), (9, text, "c"), (10, "a b\n" * 20_000, "a")])
    rows = lines.dedup_chunks(df).collect()
    assert len(rows) == 8 and {r.source: r.text for r in rows if r.doc_id == 1} == {"a": text, "b": text}
    assert next(r for r in rows if r.doc_id == 9).text == "" and next(r for r in rows if r.doc_id == 2).text is None
    assert lines.dedup_chunks(df.limit(0)).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(" ".join(words(20, k)) for k in range(4))
    names = ["_th", "_kept", "_gone", "_gid", "_gth", "th", "c0", "id", "gone", "u", "a.b"]
    df = spark.createDataFrame([(1, text, *range(11)), (2, text, *range(11, 22))], ["doc_id", "text", *names])
    out = lines.dedup_chunks(df)
    assert out.columns == [*df.columns, "_n_removed"]
    assert {tuple(r) for r in out.collect()} == {(1, text, *range(11), 0), (2, "", *range(11, 22), 4)}


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows():
    rnd, rows = random.Random(8), []
    for g in range(12):
        base = words(80, g)
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(80)] = "changed" + str(rnd.randrange(9))
            rows.append((len(rows) * 3 % 97, " ".join(w)))
    return rows + [(300, None), (301, ""), (302, "One two"), (303, "one TWO"), (304, "one"), (305, " ".join(words(5000, 77)))]


@pytest.mark.parametrize("block", [1 << 18, 200])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    df = docs(spark, [(i, t, "s") for i, t in rows])
    want = brute_near(rows)
    for df in (df, df.repartition(5)):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == want


def template_rows(n):
    """Many texts of few shingles that make one family."""
    return [(i, " ".join([*words(11, 5), f"number{i}"])) for i in range(n)]


def test_families_of_short_texts_are_cut_by_sets(spark, monkeypatch):
    assert spark.range(1).select(minhash._blocks(F.lit(8 * 32768), F.lit(32768)), minhash._blocks(F.lit(1 << 20), F.lit(9))).first() == (8, 4)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 20)
    rows = template_rows(150)
    want = brute_near(rows)
    assert {x[1] for x in want.values()} == {0}
    found = minhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == want


def test_memory_of_two_blocks_of_short_texts():
    import tracemalloc

    sets = [minhash.shingles(t).view(np.int64) for _, t in template_rows(2 * 4096)]
    tracemalloc.start()
    part = minhash._parts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(part)) == 1 and peak < 100e6


def test_memory_of_many_short_texts_without_links():
    import tracemalloc

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 200_000, 10)) for _ in range(30_000)]
    tracemalloc.start()
    part = minhash._parts(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(part)) > 29_990 and peak < 300e6


def test_third_parties_do_not_separate_two_copies(spark, monkeypatch):
    """Short texts with smaller ids that quote passages of both and so lie in the buckets that the two share."""
    base = words(160, 41)
    other = list(base)
    other[70] = "changed"
    rnd = random.Random(6)
    quotes = [(i, " ".join(w for _ in range(3) for at in [rnd.randrange(150)] for w in base[at : at + 9])) for i in range(20)]
    rows = [*quotes, (1000, " ".join(base)), (1001, " ".join(other))]
    want = brute_near(rows)
    assert want[1001][1] == 1000
    df = docs(spark, [(i, t, "s") for i, t in rows])
    for small in (16, 2):
        monkeypatch.setattr(minhash, "SMALL", small)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == want


def test_clusters_of_a_large_family(spark, monkeypatch):
    """Two clusters of near copies around one template, and loose texts of it, in blocks of ten sets."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 10)
    monkeypatch.setattr(minhash, "SMALL", 4)
    template, rnd, rows = words(60, 1), random.Random(4), []
    for i in range(90):
        own = words(40, 2 if i % 3 == 0 else 3 if i % 3 == 1 else 100 + i)
        own[rnd.randrange(40)] = f"changed{i}"
        rows.append((i, " ".join(template + own)))
    want = brute_near(rows)
    assert len({x[1] for x in want.values()}) == 32
    found = minhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == want


def test_near_duplicates_of_nothing_and_repeats(spark):
    df = docs(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, "s")])
    rows = minhash.near_duplicates(df).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows if r.doc_id == 1) == 2 and {r.component_id for r in rows if r.n_shingles} == {1}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_parts_connect_what_is_linked():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.r_[np.arange(10 * (i % 5), 10 * (i % 5) + 30), rng.integers(100, 120, 2)]) for i in range(40)]
    want = np.arange(40) % 5
    assert all(((a := minhash._parts(sets, g)) [:, None] == a).tolist() == (want[:, None] == want).tolist() for g in (None, want, np.arange(40) % 10))
    cell = pd.DataFrame({"node": np.arange(40), "root": 0, "pivot": np.arange(40) == 7, "grp": None, "shingles": sets})
    edges = minhash._cell(cell.sample(frac=1, random_state=1))
    assert {(u, v) for u, v in zip(edges["u"], edges["v"])} == {(i, 7 if i % 5 == 2 else i % 5) for i in range(40) if i > 4 and i != 7 or i == 2}


def test_fine_bands_catch_what_is_similar():
    rng, missed = np.random.default_rng(9), 0
    for _ in range(300):
        s = rng.integers(0, 1 << 63, 350).astype(np.uint64)
        missed += not (minhash.fine_bands(minhash.signature(s[:300])) == minhash.fine_bands(minhash.signature(s[50:]))).any()  # similarity 5 / 7
    assert missed == 0 and len(minhash.fine_bands(minhash.signature(s))) == 57


def test_signature_estimates_similarity():
    a = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 4000).astype(np.uint64))
    x, y = minhash.signature(a[:3000]), minhash.signature(a[1000:])
    assert abs((x == y).mean() - 0.5) < 0.2 and len(x) == 2 * minhash.PERMUTATIONS


def test_hash_bits(spark):
    assert spark.range(50).select(mixing.hash60(F.col("id")).alias("h")).where("h < 0 OR h >= 1152921504606846976").count() == 0
