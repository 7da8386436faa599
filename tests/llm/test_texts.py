"""Language, quality, personal data, token files and pieces: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagmill.llm import codes, language, personal, pieces, quality

SF = "/root/testdata/sf0.001"
TEXTS = st.text(alphabet=list("aAbeLzZ.,;:!?'&$’-_ 12\t\nüÉßſİΣς字①½▁ ​́"), max_size=60)


@pytest.fixture(scope="module")
def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Personal data


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("mail a.b@c-d.example now", ["email:5:20"]), ("a@b", []), ("10.0.0.255 and 10.0.0.256", ["ip:0:10"]), ("4111 1111 1111 1111", ["card:0:19"]), ("4111 1111 1111 1112", []),
        ("+49 (30) 1234567", ["phone:0:16"]), ("+1234", []), ("", []), ("x@y.z@w.v", ["email:0:5"]),
    ],
)
def test_plain_identifiers(text, spans):
    assert [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in personal.plain(text)] == spans


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write to john.doe at example dot com please", "email", "john.doe at example dot com"), ("john (at) example [dot] org", "email", "john (at) example [dot] org"), ("john@exаmple.com", "email", "john@exаmple.com"),
        ("call plus four nine three zero one two three four five six now", "phone", "plus four nine three zero one two three four five six"), ("192 dot 168 dot 0 dot 1", "ip", "192 dot 168 dot 0 dot 1"), ("１０.0.0.1", "ip", "１０.0.0.1"),
    ],
)
def test_disguised_identifiers(text, kind, part):
    found = [text[s:e] for s, k, e in personal.disguised(text, personal.plain(text)) if personal.KINDS[k] == kind]
    assert found and part in found[0] + part and (found[0] in part or part in found[0])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=list("ab@. 19+()-４одоt"), max_size=60))
def test_spans_lie_in_the_text(text):
    base = personal.plain(text)
    for s, _, e in [*base, *personal.disguised(text, base)]:
        assert 0 <= s < e <= len(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("call plus four 9 three 0 one 2 three 4 five 6 now", "phone", "plus four 9 three 0 one 2 three 4 five 6"), ("write to john.doe at example.com please", "email", "john.doe at example.com"),
        ("write to john at example.com please", "email", "john at example.com"), ("look at john.doe at example.co.uk.", "email", "john.doe at example.co.uk"), ("plus\tone 2 3 4 5 6 7 8 9", "phone", "plus\tone 2 3 4 5 6 7 8 9"),
    ],
)
def test_mixed_disguises(text, kind, part):
    assert part in [text[s:e] for s, k, e in personal.disguised(text, personal.plain(text)) if personal.KINDS[k] == kind]


def contract(text):
    """The four fixed patterns by plain scans, and the conditions on what they match."""
    out = []
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            total = sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits)))
            if [True, all(int(x) <= 255 for x in m[0].split(".") if kind == 1), 12 <= len(digits) <= 19 and total % 10 == 0, 9 <= len(digits) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "12", "3", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "é", "\n", "10.0.0", "255", "256", "+49 30 123456"]), max_size=24))
def test_plain_spans_are_those_of_the_fixed_patterns(parts):
    text = "".join(parts)
    assert personal.plain(text) == contract(text)


def test_plain_spans_of_all_documents(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert personal.plain(r.text or "") == contract(r.text or "")


SPELL = dict(zip("0123456789", "zero one two three four five six seven eight nine".split(), strict=True))


def disguises(rnd):
    """(kind, the disguised identifier) of many kinds."""
    card = rnd.choice(["4111111111111111", "5555555555554444", "378282246310005"])
    phone, ip = "+" + "".join(rnd.choice("123456789") for _ in range(11)), ".".join(str(rnd.randrange(256)) for _ in range(4))
    name, host = rnd.choice(["john", "j.doe", "ann_b", "x" * 70]), rnd.choice(["example.com", "mail.example.org"])
    spell = lambda text, by=" ": by.join(SPELL.get(c, {"+": "plus", ".": "dot"}.get(c, c)) for c in text)
    return [
        ("card", "spelled", spell(card)), ("card", "every second", " ".join(SPELL[c] if i % 2 else c for i, c in enumerate(card))), ("card", "a line each", spell(card, "\n")), ("card", "full width", "".join(chr(ord(c) + 0xFEE0) for c in card)),
        ("card", "zero width", "\u200b".join(card)), ("phone", "spelled", spell(phone)), ("phone", "commas", spell(phone, ", ")), ("phone", "hyphens", spell(phone, "-")), ("ip", "spelled", spell(ip)), ("ip", "dots", ip.replace(".", " dot ")), ("ip", "brackets", ip.replace(".", "[.]")),
        ("email", "brackets", f"{name} [at] {host.replace('.', ' [dot] ')}"), ("email", "words", f"{name} at {host.replace('.', ' dot ')}"), ("email", "blanks", f"{name} @ {host}"), ("email", "one dot", f"{name}@{host.replace('.', ' dot ')}"),
        ("email", "look-alike name", f"{name}о@{host}"), ("email", "look-alike inside", f"аj{name}@{host}"), ("email", "look-alike host", f"{name}@{host.replace('e', 'е')}"), ("email", "combining", f"{name[0]}\u0301{name[1:]}@{host}"), ("email", "Armenian", f"օ{name}@{host}"),
    ]


def test_recall_by_kind_of_disguise():
    """What is planted is covered by one span of its kind, whatever its disguise."""
    rnd, missed = random.Random(5), {}
    for _ in range(40):
        for kind, how, planted in disguises(rnd):
            text = f"Some words before, then: {planted} ; and after."
            base = personal.plain(text)
            spans = [(s, e) for s, k, e in [*base, *personal.disguised(text, base)] if personal.KINDS[k] == kind]
            at = text.index(planted)
            if not any(s <= at and at + len(planted) <= e for s, e in spans):
                missed[kind, how] = missed.get((kind, how), 0) + 1
    assert not missed


def test_rows_of_spelled_cards():
    text = " ".join(SPELL[c] for c in "4111111111111111" + "5555555555554444")
    found = personal.disguised(text, [])
    assert [(text[s : s + 4], text[e - 4 : e]) for s, k, e in found if k == 2] == [("four", " one"), ("five", "four")]
    assert personal.disguised("one two three four five six seven eight nine one two three four five six seven eight nine one two", []) == []


def test_longer_spans_stand_beside_plain_ones():
    text = "jоhn.dоe@example.com"
    base = personal.plain(text)
    assert base == [(7, 0, 20)] and personal.disguised(text, base) == [(0, 0, 20)]


def test_numbers_beside_plain_ones_change_nothing():
    for text in ("+33 1 23 45 67 89 un jour", "4111 1111 1111 1111 one day", "mail a.b@example.com point taken", "hi @john.doe and 10.0.0.1 one two"):
        assert personal.disguised(text, personal.plain(text)) == []


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "a@b.c", "x", 1), (1, "a@b.c", "x", 2), (None, "a@b.c", None, 3), (2, None, "y", 4), (3, "", "y", 5), (4, " " * 300_000 + "a [at] b.c" + " at" * 100_000, "y", 6), (5, "@ " * 100_000 + "1 dot " * 50_000, "y", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int")
    found = sorted((r.doc_id or 0, len(r.spans)) for r in personal.find_personal(df).collect())
    assert [x for x in found if x[0] < 4] == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)] and next(n for i, n in found if i == 4) == 1
    assert personal.find_personal(df.limit(0)).count() == 0


def test_places_are_no_addresses():
    for text in ("Look at example.com or visit us at shop.example.org.", "contact us at example.com", "We met at 5.30 at home."):
        assert personal.disguised(text, []) == []


def test_plain_text_stays_clean():
    assert personal.disguised("Meet me at the station, dot by dot. One two three!", []) == []


def test_personal_query(spark):
    rows = {r.doc_id: r for r in personal.op8_personal_data(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    import hashlib

    for i, r in rows.items():
        base = personal.plain(docs[i])
        text = ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        all_spans = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(all_spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in all_spans) for k in personal.KINDS)


# Token files


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_encode_as_the_whole_text_does(word_file, text):
    encoder = codes.word_encoder(word_file)
    assert encoder.encode(text) == np.array(encoder._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_small_memory_gives_the_same_ids(word_file, monkeypatch):
    monkeypatch.setattr(codes, "CACHED_WORDS", 5)
    encoder, rnd = codes.WordEncoder(word_file), random.Random(1)
    for _ in range(200):
        text = " ".join(rnd.choice(["One,", "one", "two!", "Three", "four.", "FIVE", "six?!", "x-.", "7."]) for _ in range(9))
        assert encoder.encode(text) == np.array(encoder._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 49407)), max_size=700), max_size=6))
def test_codes_round_trip_and_random_access(docs):
    ids = np.array([x for d in docs for x in d], "<u4")
    found = codes.Codes(codes.pack(list(range(len(docs))), [len(d) for d in docs], ids))
    assert found.tokens().tolist() == ids.tolist() and found.starts.tolist() == [0, *np.cumsum([len(d) for d in docs])]
    for i in random.Random(0).sample(range(len(ids)), min(20, len(ids))):
        assert found.token(i) == ids[i]
    with pytest.raises(IndexError):
        found.token(len(ids))


def test_ranged_reads_take_few_bytes(spark, word_file, tmp_path, monkeypatch):
    ids = np.random.default_rng(1).zipf(1.3, 200_000).clip(0, 60_000).astype("<u4")
    data, taken = codes.pack([5, None], [150_000, 50_000], ids), []

    def read_at(size, offset):
        taken.append(size)
        return data[offset : offset + size]

    found = codes.RangedCodes(read_at)
    assert [found.start(k) for k in range(3)] == [0, 150_000, 200_000]
    for i in range(0, len(ids), 1999):
        assert found.token(i) == ids[i]
    assert max(taken) <= 64 and len(taken) < 20 * (len(ids) // 1999 + 2)
    df = spark.createDataFrame([(1, "one two three"), (2, "x" * 300)], "doc_id long, text string")
    for r in codes.write_tokens(df, f"file://{tmp_path}/r", word_file).collect():
        whole = codes.Codes(open(r.file.removeprefix("file://"), "rb").read()).tokens().tolist()
        assert [codes.open_codes(r.file).token(i) for i in range(r.n_ids)] == whole
    encoder = codes.WordEncoder(word_file)
    encoder.encode("x" * 300 + " y")
    assert not any(len(w) > codes.LONGEST_WORD for w in encoder._young)


def test_many_ids_reach_the_third_level():
    ids = np.random.default_rng(0).permutation(np.repeat(np.arange(70_000), 2)).astype("<u4")
    found = codes.Codes(codes.pack([1], [len(ids)], ids))
    assert len(found.levels) == 3 and (found.tokens() == ids).all() and all(found.token(i) == ids[i] for i in range(0, len(ids), 9973))


def test_token_query(spark, word_file, monkeypatch):
    monkeypatch.setattr(codes, "FILE_IDS", 20_000)
    tokenizer = codes.word_encoder(word_file)._tokenizer
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = {}, 0
    for i, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in codes.op6_token_codes(spark, SF).collect()} == want


def test_token_files_of_odd_rows(spark, word_file, tmp_path):
    df = spark.createDataFrame([(2, "b"), (None, None), (1, ""), (1, "a a")], "doc_id long, text string")
    found = codes.read_tokens(codes.write_tokens(df, f"file://{tmp_path}/t", word_file))
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in found.collect())
    assert [r[1] for r in rows] == [None, 1, 1, 2] and [r[0] for r in rows] == [0, *np.cumsum([r[2] for r in rows])[:-1]]
    assert codes.read_tokens(codes.write_tokens(df.limit(0), f"file://{tmp_path}/e", word_file)).count() == 0


# Pieces


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.Transducer(pieces.model_path())


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_are_the_models_own(processor, text):
    own, t = processor
    coded = t.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == own.encode(text)
    assert t.decode(np.frombuffer(coded, "<u4")) == text.replace("▁", " ")


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The pieces with their scores as a unigram model, with and without byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    out = []
    for name in ("bytes", "none"):
        model = pb.ModelProto()
        model.ParseFromString(open(pieces.model_path(), "rb").read())
        model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
        if name == "none":
            model.trainer_spec.byte_fallback = False
            kept = [p for p in model.pieces if p.type != pb.ModelProto.SentencePiece.BYTE]
            del model.pieces[:]
            model.pieces.extend(kept)
        path = tmp_path_factory.mktemp("unigram") / f"{name}.model"
        path.write_bytes(model.SerializeToString())
        out.append((sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Transducer(str(path))))
    return out


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_pieces_of_unigram_models(unigram, text):
    for own, t in unigram:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == own.encode(text)


def test_pieces_of_long_and_odd_texts(processor):
    own, t = processor
    for text in ("a" * 20_000, "字" * 3000, " " * 500 + "x", "Thlyouble inesea ononedth " * 200, "\U0001f600" * 50):
        assert np.frombuffer(t.encode(text), "<u4").tolist() == own.encode(text)
    assert all(len(k) <= t.parts.LONGEST for k in t.parts)


def test_piece_queries(spark, processor):
    own, _ = processor
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pieces.op10_sentencepiece(spark, SF).collect()
    assert all(r.round_trip for r in rows)
    assert {r.doc_id: (r.n_pieces, r.ids_crc32) for r in rows} == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in ((i, own.encode(t)) for i, t in docs.items())}


def test_encode_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([("a b", [7], "x", 1)], "text string, piece_ids array<int>, spelled string, n int")
    coded = pieces.encode_pieces(df, pieces.model_path(), spelled_col="spelled")
    assert coded.columns == ["text", "n", "piece_ids", "spelled"] and coded.first().spelled == "a b"


def test_encode_keeps_columns_and_decodes(spark):
    df = spark.createDataFrame([("a b", "k", 1), (None, "k", 2), ("", None, 3)], "text string, piece string, ids int")
    coded = pieces.encode_pieces(df, pieces.model_path(), spelled_col="spelled")
    assert coded.columns == ["text", "piece", "ids", "piece_ids", "spelled"]
    assert {r.ids: r.spelled for r in coded.collect()} == {1: "a b", 2: "", 3: ""}
    assert {r.ids: r.text for r in pieces.decode_pieces(coded, pieces.model_path()).collect()} == {1: "a b", 2: "", 3: ""}


# Classifiers


def test_language_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in language.op3_language_id(spark, folder).collect()]
    held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "abc " * 100_000)], "id long, text string")
    model = language.fit([("abc def abc", "x"), ("uvw xyz", "y")] * 30)
    rows = {r.id: (r.lang_pred, r.score) for r in language.identify(df, model).collect()}
    assert rows[1] == rows[2] == rows[3] == ("und", 0.0) and rows[4][0] == "x"
    assert {r.lang_pred for r in language.identify(df, language.fit([])).collect()} == {"und"}
    assert language.identify(df.limit(0), model).count() == 0


def test_quality_grades(spark):
    rnd = random.Random(3)
    good, poor, bad = ([" ".join(rnd.choice(v) for _ in range(30)) for _ in range(120)] for v in (["fine", "text", "word", "more"], ["fine", "text", "buy", "CLICK"], ["fine", "awful", "text"]))
    model = quality.fit([(t, 2) for t in good[:80]] + [(t, 1) for t in poor[:80]] + [(t, 0) for t in bad[:80]], 3)
    df = spark.createDataFrame([(i, t, g, "c") for g, ts in ((2, good), (1, poor), (0, bad)) for i, t in enumerate(ts[80:])] + [(0, None, 9, "c"), (0, "", 9, "c")], "doc_id long, text string, g int, grade string")
    rows = quality.with_grades(df, model).collect()
    assert np.mean([abs(r.expected_grade - r.g) < 0.6 for r in rows if r.g < 9]) > 0.9
    assert all(0 <= r.tail_prob <= 1 for r in rows) and all(r.tail_prob > 0.5 for r in rows if r.g in (2, 9))
    assert (np.diff(model.thresholds) > 0).all()


def test_every_language_is_learned(spark):
    """Also more languages than 200, by bags instead of texts; few grams leave fewer rows, not fewer languages."""
    rows = [(i, f"{chr(0x4E00 + i % 250)}{chr(0x5E00 + i % 250)} " * 5, f"l{i % 250}", "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, score string")
    got = language.sample(df, F.col("id"), 3)
    assert len(got) == 750 and len({v for _, v in got}) == 250
    model = language.fit_bags(got)
    assert len(model.languages) == 250
    few = language.identify(df.where("id < 50"), model).collect()
    assert np.mean([r.lang_pred == f"l{r.id % 250}" for r in few]) > 0.8


def test_thousands_of_languages(spark, monkeypatch):
    """The model grows by WIDTH numbers a language; scores are those of the folded model; a model too large is refused."""
    n = 2000
    rng = np.random.default_rng(2)
    rows = [([(rng.integers(0, language.BUCKETS, 12).astype(np.uint32), np.full(12, 1 / 12, np.float32))], f"l{i:04}") for i in range(n) for _ in range(3)]
    monkeypatch.setattr(language, "EPOCHS", 1)
    model = language.fit_bags(rows)
    assert len(model.languages) == n and model.table.nbytes + model.out.nbytes < 3 << 20
    texts = ["abc", "some words of a text", "x" * 5000]
    monkeypatch.setattr(language, "CELLS", n)  # one text at once
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).collect()
    folded = language.Model.__new__(language.Model)
    folded.__dict__.update(model.__dict__, table=model.logits, out=None)
    first, p = folded.best(language._hidden(folded, texts))
    assert [(r.lang_pred, round(r.score, 9)) for r in sorted(got)] == [(model.languages[i], round(x, 9)) for i, x in zip(first, p)]
    with pytest.raises(ValueError, match="languages"):
        language.Model([str(i) for i in range(200_000)], model.table, np.zeros(200_000), np.zeros((16, 200_000)))


def test_few_grams_leave_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_GRAMS", 100)
    df = spark.createDataFrame([(i, "abc def " * (1 + i), "ab"[i % 2]) for i in range(40)], "id long, text string, lang string")
    got = language.sample(df, F.col("id"))
    assert {v for _, v in got} == {"a", "b"} and len(got) < 40


def test_language_scores_by_a_plain_loop(spark):
    """The score of a text is the softmax of the mean of its grams' logits, one gram at a time."""
    model = language.fit([("abc def abc", "x"), ("uvw xyz", "y"), ("mno", "z")] * 20)
    for text in ("abc xyz", "Mno", "a", "ü abc"):
        padded, z, n = f" {text} ".lower(), np.zeros(3), 0
        for order in language.ORDERS:
            for i in range(len(padded) - order + 1):
                codes_ = [np.uint32(ord(c)) for c in padded[i : i + order]]
                with np.errstate(over="ignore"):
                    h = codes_[0]
                    for c in codes_[1:]:
                        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + c
                    g = (h ^ np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                z += model.logits[int(g >> np.uint32(7)) % language.BUCKETS]
                n += 1
        p = np.exp((z / n + model.bias) / model.temperature)
        p /= p.sum()
        r = language.identify(spark.createDataFrame([(1, text)], "id long, text string"), model).first()
        assert r.lang_pred == model.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-9)


def test_language_of_repeated_rows_and_other_columns(spark):
    model = language.fit([("abc", "x"), ("xyz", "y")] * 20)
    df = spark.createDataFrame([(1, "abc", "q", 1.0), (1, "abc", "q", 2.0), (None, "abc xyz", None, None)], "id long, text string, lang_pred string, score double")
    rows = language.identify(df, model).collect()
    assert len(rows) == 3 and len({(r.lang_pred, r.score) for r in rows if r.id == 1}) == 1
    rows = language.identify(spark.createDataFrame([(1, "q q")], "id long, text string"), language.fit([("abc", "y"), ("abc", "x")] * 9)).collect()
    assert rows[0].lang_pred in ("x", "y")


def test_quality_scores_by_a_plain_loop(spark):
    model = quality.fit([("good text here", 2), ("buy now NOW", 1), ("awful awful", 0)] * 30, 3)
    df = spark.createDataFrame([(1, "buy awful text"), (2, ""), (3, None), (4, "good " * 200_000)], "doc_id long, text string")
    for r in quality.with_grades(df, model).collect():
        z = sum(np.float32(model.weights)[quality.bucket(kind, x)] for kind, names in quality.feature_sets(r.text or "").items() for x in names)
        upto = [*(1 / (1 + np.exp(-(t - z))) for t in model.thresholds), 1.0]
        p = [upto[0], upto[1] - upto[0], upto[2] - upto[1]]
        assert r.expected_grade == pytest.approx(p[1] + 2 * p[2], abs=1e-5) and r.tail_prob == pytest.approx(p[2], abs=1e-5)


def test_quality_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "a", "z", 1)], "doc_id long, text string, tail_prob string, expected_grade int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.graded_documents(df, labels)
    assert out.columns == ["doc_id", "text", "expected_grade", "tail_prob", "keep"] and out.first().keep


def test_quality_without_ratings(spark):
    docs = spark.createDataFrame([(1, "a", "z"), (1, None, "z")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert quality.graded_documents(docs, labels).where("keep").count() == 2
    assert quality.graded_documents(docs.limit(0), labels).count() == 0


def test_quality_query_keeps_clean_documents_and_drops_toxic_ones(spark):
    folder = "/root/testdata/sf0.01"
    keep = {r.doc_id: r.keep for r in quality.op5_ordinal_quality(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean, toxic = [[keep[r.doc_id] for r in labels if f(r) and r.doc_id in keep] for f in (lambda r: r.quality == 1 and not r.toxic, lambda r: r.toxic == 1)]
    assert np.mean(clean) > 0.95 and np.mean(toxic) < 0.1
