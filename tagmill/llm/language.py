"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's hidden vector is the mean of the embeddings of its hashed character grams (as in fastText); a linear softmax
gives the languages' probabilities. Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of the labelled rows of every language, on whole texts and on short pieces of them. Tasks turn the sample
into numbers of hashed grams; no text reaches the driver. A temperature fitted on a third of the
sample kept aside calibrates the probabilities; a prediction below the least calibrated probability at which nine of ten
answers of that third are right is marked as rejected.

Both layers are linear. With up to WIDTH languages they are folded into one table of BUCKETS x languages, of which
prediction adds up a row for each gram; with more, tasks get the embeddings (BUCKETS x WIDTH) and the softmax layer (WIDTH x
languages). A model beyond MODEL_BYTES, some 70,000 languages, is refused when it is made; a softmax is taken over CELLS
numbers at once.

Cases: null texts and texts without a letter get ``und`` and score 0; rows with null text or language teach nothing;
without labelled rows every text is ``und``; rows that repeat are rows of their own; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, table
from .features import grams, summed

ORDERS, BUCKETS, WIDTH = (1, 2, 3), 1 << 14, 16
#: The sample: at most so many rows of each language, and SAMPLE_GRAMS distinct grams (12 bytes each) in all; beyond, fewer
#: rows of each language, at least one.
ROWS_EACH, SAMPLE_GRAMS, EPOCHS, RATE, RIGHT = 500, 20_000_000, 6, 2.0, 0.9
PIECES, LEAST_WORDS, MOST_WORDS = 4, 1, 25
#: Up to so many languages (a name and a number each, a few MB) their counts are broadcast, so that no text is shuffled.
BROADCAST_LANGUAGES = 100_000
#: Bytes of a model, which travels to every task; numbers (texts x languages) of a softmax taken at once.
MODEL_BYTES, CELLS = 16 << 20, 1 << 21


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, or BUCKETS x WIDTH
    bias: np.ndarray
    out: np.ndarray | None = None  # WIDTH x languages
    temperature: float = 1.0
    least: float = 0.0

    def __post_init__(self) -> None:
        size = self.table.nbytes + self.bias.nbytes + (0 if self.out is None else self.out.nbytes) + sum(map(len, self.languages))
        if size > MODEL_BYTES:
            raise ValueError(f"a model of {len(self.languages)} languages has {size} bytes; {MODEL_BYTES} can travel to the tasks")

    @property
    def logits(self) -> np.ndarray:
        """BUCKETS x languages."""
        return self.table if self.out is None else self.table @ self.out

    def scores(self, hidden: np.ndarray) -> np.ndarray:
        return (hidden if self.out is None else hidden @ self.out) + self.bias

    def best(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most probable language of each row, by number, and its probability."""
        found, step = [], max(1, CELLS // max(1, len(self.languages)))
        for at in range(0, len(hidden), step):
            p = _softmax(self.scores(hidden[at : at + step]) / self.temperature)
            found.append((p.argmax(axis=1), p.max(axis=1)))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


#: Of a sampled text and its pieces: ids of the grams and their shares.
Bag = tuple[np.ndarray, np.ndarray]


def sample(labelled: DataFrame, key: Column, rows_each: int = ROWS_EACH) -> list[tuple[list[Bag], str]]:
    """(bags, lang) of at most rows_each rows of every language, chosen by a hash of the key: the same rows each run."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", F.xxhash64(key, F.lit("language")).alias("h"))
    counts = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    share = F.least(F.lit(1.0), F.lit(3.0 * rows_each) / F.col("n"))  # leaves a few rows for the window, not a language
    near = rows.join(counts, "lang").where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < share)
    order = W.partitionBy("lang").orderBy("h", "text")
    first = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows_each)

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lang, k, h, text in zip(pdf["lang"], pdf["k"], pdf["h"], pdf["text"], strict=True):
                of = _text_bags(text, np.random.default_rng(h & (1 << 63) - 1))
                yield pd.DataFrame({"lang": [lang], "k": [k], "n": [sum(len(x) for x, _ in of)], "ids": [[x.astype("<i4").tobytes() for x, _ in of]], "shares": [[w.astype("<f4").tobytes() for _, w in of]]})

    found = cut(first.mapInPandas(bags, "lang string, k int, n long, ids array<binary>, shares array<binary>"))
    n_languages = found.select("lang").distinct().count()
    upto = F.sum("n").over(W.partitionBy("lang").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    within = found.withColumn("upto", F.coalesce(upto, F.lit(0))).where((F.col("upto") + F.col("n") <= SAMPLE_GRAMS // max(1, n_languages)) | (F.col("k") == 1))
    picked = within.orderBy("lang", "k").select("lang", "ids", "shares").collect()
    return [([(np.frombuffer(x, "<i4"), np.frombuffer(w, "<f4")) for x, w in zip(r.ids, r.shares, strict=True)], r.lang) for r in picked]


def _text_bags(text: str, rng: np.random.Generator) -> list[Bag]:
    """The bags of a text and of PIECES short pieces of it."""
    words, out = text.split(), [text]
    for _ in range(PIECES if words else 0):
        n = int(rng.integers(LEAST_WORDS, MOST_WORDS + 1))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[at : at + n]))
    return _bags(out)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their shares."""
    bags: list[list] = [[] for _ in texts]
    for first, last, g, of in grams(texts, ORDERS, BUCKETS):
        cuts = np.searchsorted(np.sort(of, kind="stable"), np.arange(first, last + 1))
        g = g[np.argsort(of, kind="stable")]
        for i in range(first, last):
            bags[i].append(g[cuts[i - first] : cuts[i - first + 1]])
    out = []
    for parts in bags:
        ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0))
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, lang) rows."""
    rng = np.random.default_rng(seed)
    return fit_bags([(_text_bags(t, rng), lang) for t, lang in rows], seed)


def fit_bags(rows: list[tuple[list[Bag], str]], seed: int = 7) -> Model:
    """Train on two thirds of the rows, calibrate on the others."""
    languages = sorted({lang for _, lang in rows})
    index, rng = {lang: i for i, lang in enumerate(languages)}, np.random.default_rng(seed)
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    aside = [(b, index[lang]) for i, (of, lang) in enumerate(rows) if i % 3 == 2 for b in of]
    learn = [(b, index[lang]) for i, (of, lang) in enumerate(rows) if i % 3 != 2 for b in of]
    y, bags = np.array([v for _, v in learn]), [b for b, _ in learn]
    share = np.bincount(y, minlength=len(languages))
    emb = (rng.standard_normal((BUCKETS, WIDTH)) / WIDTH).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, w = bags[i]
            rate = RATE * (1 - done / steps) / max(1e-9, share[y[i]] / share.mean()) ** 0.5
            done += 1
            if not len(ids):
                continue
            hidden = w @ emb[ids]
            p = _softmax(hidden @ out + bias)
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            emb[ids] -= (rate * w)[:, None] * back
    if len(languages) <= WIDTH:
        model = Model(languages, (emb @ out).astype(np.float64), bias.astype(np.float64))
    else:
        model = Model(languages, emb.astype(np.float64), bias.astype(np.float64), out.astype(np.float64))
    if aside:
        y = np.array([v for _, v in aside])
        hidden = np.stack([w @ model.table[ids] for (ids, w), _ in aside])
        losses, step = dict.fromkeys(np.geomspace(0.1, 10, 61), 0.0), max(1, CELLS // len(languages))
        for at in range(0, len(y), step):
            z, own = model.scores(hidden[at : at + step]), y[at : at + step]
            for t in losses:
                losses[t] -= np.log(_softmax(z / t)[np.arange(len(own)), own] + 1e-12).sum()
        model.temperature = float(min(losses, key=losses.get))
        first, p = model.best(hidden)
        order = np.argsort(-p, kind="stable")
        right = np.cumsum((first == y)[order]) / np.arange(1, len(order) + 1)
        model.least = float(p[order][np.flatnonzero(right >= RIGHT)[-1]]) if (right >= RIGHT).any() else 1.0
    return model


def _hidden(model: Model, texts: list[str]) -> np.ndarray:
    sums, n = summed(texts, model.table, ORDERS)
    return sums / np.maximum(n, 1)[:, None]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (id and text) to id, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            some = pdf["letters"].to_numpy(bool) & bool(m.languages)
            lang, score = np.full(len(pdf), "und", object), np.zeros(len(pdf))
            if some.any():
                first, score[some] = m.best(_hidden(m, pdf["text"][some].tolist()))
                lang[some] = np.array(m.languages, object)[first]
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "lang_pred": lang, "score": score, "rejected": score < m.least})

    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInPandas(predict, "id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    model = fit_bags(sample(docs.where(~held_out(F.col("id"))), F.col("id")))
    found = identify(docs, model)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict = {}
