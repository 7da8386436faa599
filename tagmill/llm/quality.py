"""Ordinal quality classifier: cumulative-link regression on hashed text.

Grades are ordered; P(grade <= j) = logistic(t_j - z) with ordered thresholds t_j and one score z for all of them. z adds
up the weights of the hashed features of a text's distinct words (the word, its first letters, its trailing signs, capitals)
and of the share of words that repeat the one before. A weight is never positive: features are signs that lower the grade,
and a text without any, however short or long, gets the highest. Weights and thresholds are fitted in numpy, by the likelihood's
gradient with per-coordinate rates and an L1 penalty (FTRL), on a bounded sample of the rated documents. The model gives
the expected grade and the probability of the upper grades, by which documents are selected. Texts become features in the
tasks: the driver gets numbers, never texts, at most SAMPLE_FEATURES of them.

Cases: ratings that are null, and rated ids without a text, teach nothing; of several ratings of a document the lowest
counts; a null text has no words; without ratings every document gets probability 1 and is kept; rows that repeat are
rows of their own; empty tables give an empty result; other columns are carried along by ``with_grades``, but for those
called like its results, which are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

from .common import Memo, cut, table

#: The sample: at most so many documents of each grade, by hash; passes over them; the selection's least probability.
ROWS_EACH, EPOCHS, LEAST = 3000, 4, 0.5
BUCKETS, RATE, L1 = 1 << 18, 0.15, 4.0
#: Features of all sampled documents together that the driver learns from (8 bytes each); beyond, fewer documents of each grade.
SAMPLE_FEATURES = 20_000_000
#: Words of a kind in each of the two generations whose weights a worker remembers.
CACHED_WORDS = 100_000


def feature_sets(text: str) -> dict[str, set[str]]:
    """The features of a text by kind: words, their first 5 letters, trailing signs, shares of capitals and repeats."""
    tokens = text.split()
    words = {w.strip(".,;:!?") for w in set(text.lower().split())}
    n = max(1, len(tokens))
    upper = sum(map(str.isupper, tokens)) * 10 // n
    same = sum(map(operator.eq, tokens, tokens[1:])) * 10 // n
    return {
        "word": words,
        "five": {w[:5] for w in words},
        "tail": {w[-2:] for w in set(tokens) if not w[-1].isalnum()},
        "share": {f"upper{i}" for i in range(1, upper + 1)} | {f"same{i}" for i in range(1, same + 1)},
    }


def bucket(kind: str, name: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    known: dict[str, Memo] = field(default_factory=dict)

    def score(self, text: str) -> float:
        total = 0.0
        for kind, names in feature_sets(text).items():
            if kind not in self.known:
                self.known[kind] = Memo(lambda name, kind=kind: float(self.weights[bucket(kind, name)]), CACHED_WORDS)
            total += sum(sorted(map(self.known[kind].__getitem__, names)))  # in order: sums must not depend on the hash seed
        return total

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade) for each score."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))
        return np.diff(np.concatenate([np.zeros((len(z), 1)), upto, np.ones((len(z), 1))], axis=1), axis=1)


def features(text: str) -> np.ndarray:
    """A text's distinct features."""
    return np.unique(np.array([bucket(kind, x) for kind, names in feature_sets(text).items() for x in names], np.int64))


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(500.0, max(-500.0, x))))


def fit(rows: list[tuple[str, int]], n_grades: int, seed: int = 3) -> Model:
    """Weights and thresholds from (text, grade)."""
    return fit_features([(features(t), g) for t, g in rows], n_grades, seed)


def fit_features(rows: list[tuple[np.ndarray, int]], n_grades: int, seed: int = 3) -> Model:
    """Weights and thresholds from (features, grade)."""
    cuts = -2.0 * np.arange(n_grades - 1, 0, -1.0)  # a text without telling features gets the highest grade
    if not rows:
        return Model(np.zeros(BUCKETS), np.full(n_grades - 1, -500.0))
    bags = [b for b, _ in rows]
    grades = [g for _, g in rows]
    w, z, n = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, g = bags[i], grades[i]
            y = float(w[ids].sum())
            above = 1.0 if g == n_grades - 1 else _logistic(cuts[g] - y)
            below = 0.0 if g == 0 else _logistic(cuts[g - 1] - y)
            p = max(above - below, 1e-9)
            slope = -(above + below - 1)  # of the loss, by y
            square = slope * slope
            sigma = (np.sqrt(n[ids] + square) - np.sqrt(n[ids])) / RATE
            z[ids] += slope - sigma * w[ids]
            n[ids] += square
            w[ids] = -np.maximum(z[ids] - L1, 0) * RATE / (1 + np.sqrt(n[ids]))  # never positive
            step = 0.01 / (1 + epoch)
            if g < n_grades - 1:
                cuts[g] += step * min(5.0, above * (1 - above) / p)
            if g:
                cuts[g - 1] -= step * min(5.0, below * (1 - below) / p)
            cuts = np.maximum.accumulate(cuts + np.arange(n_grades - 1) * 1e-3) - np.arange(n_grades - 1) * 1e-3
    return Model(w, cuts)


def rated_sample(docs: DataFrame, ratings: DataFrame, n_grades: int, rows_each: int = ROWS_EACH) -> list[tuple[np.ndarray, int]]:
    """(features, grade) of at most rows_each documents of each grade, chosen by hash among ``ratings`` (doc_id, grade)."""
    one = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    h = F.xxhash64("doc_id", F.lit("rated"))
    picked = None
    for g in range(n_grades):  # a top-k by hash: bounded in every task
        some = one.where(F.col("grade") == g).orderBy(h, "doc_id").limit(rows_each)
        picked = some if picked is None else picked.union(some)
    picked = picked.collect()  # at most n_grades * rows_each pairs of numbers
    if not picked:
        return []
    few = F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, grade int"))
    texts = docs.where("text is not null").select("doc_id", "text").join(few, "doc_id")
    first = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            of = [features(t).astype("<i4") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "n": [len(x) for x in of], "bag": [x.tobytes() for x in of]})

    found = cut(first.mapInPandas(bags, "doc_id long, grade int, n long, bag binary"))
    order = W.partitionBy("grade").orderBy(h, "doc_id").rowsBetween(W.unboundedPreceding, 0)
    within = found.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= SAMPLE_FEATURES // n_grades)
    return [(np.frombuffer(r.bag, "<i4").astype(np.int64), r.grade) for r in within.orderBy("doc_id").select("bag", "grade").collect()]


def with_grades(docs: DataFrame, model: Model, text_col: str = "text", upper: int | None = None) -> DataFrame:
    """``docs`` with expected_grade and tail_prob: the probability of ``upper`` (the highest grade) or more."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    at = len(model.thresholds) if upper is None else upper
    docs = docs.drop("expected_grade", "tail_prob")
    schema = StructType([*docs.schema.fields, StructField("expected_grade", DoubleType()), StructField("tail_prob", DoubleType())])

    def predict(parts: Iterator) -> Iterator:
        import pyarrow as pa

        m = Model(*shared.value)
        for batch in parts:
            z = np.array([m.score(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
            p = m.probabilities(z)
            found = [pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, at:].sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "expected_grade", "tail_prob"])

    return docs.mapInArrow(predict, schema)


def grade(quality: Column, toxic: Column) -> Column:
    """Toxic is 0, of low quality 1, good 2."""
    return F.when(toxic == 1, 0).when((quality == 0) & (toxic == 0), 1).when((quality == 1) & (toxic == 0), 2).cast("int")


def graded_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with expected_grade, tail_prob and keep, by a model fitted on ``labels``."""
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit_features(rated_sample(docs, ratings, 3), 3)
    return with_grades(docs, model).withColumn("keep", F.col("tail_prob") >= LEAST)


def op5_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "tail_prob", "keep")


QUERIES = {"op5_ordinal_quality": op5_ordinal_quality}
ORACLE: dict = {}
