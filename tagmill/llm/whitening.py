"""Whitening of embeddings by principal components, from an exact integer scatter matrix.

A component c becomes the whole number floor(256 * c). The fit list holds each distinct vector once. A task subtracts a
shift (whole numbers near the mean, which no result depends on) and multiplies its vectors in limbs of LIMB bits, so that
every product and sum of a matrix product is a whole number that a double holds exactly; what the products give is
added up in Python's integers of any size. The tasks' sums meet row by row of the matrix, streamed, and the driver gets
one row a dimension: n, the sums S and the cross-products XᵀX. Only n·XᵀX - SSᵀ, still exact, is divided by n² and
becomes floating point, for the decomposition by eigh. The driver and each task thus hold a few dimensions x dimensions
numbers, whatever the number of vectors.

Cases: vectors that are null, empty or hold null or non-finite components take no part; of vectors of several lengths
the most frequent length counts (of equals the greater) and the others take no part; a vector on many rows counts once
in the fit and gets a result on each row, also where its id is null or stands on other rows; numbers beyond HELD are held
to it; a component whose variance is zero (to double precision) has null ``whitened`` and is left out of the error; with
fewer than ``k`` dimensions there are as many components as dimensions; a deviation beyond 38 digits is null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid
from .common import cut, table

#: Bits of a limb, and vectors multiplied at once: 2 * LIMB + log2(ROWS) bits fit the 53 of a double.
LIMB, ROWS = 20, 1 << 12
#: Whole numbers are held to this range, so that a difference of two fits 64 bits.
HELD = (1 << 62) - 1
#: Vectors that the shift is the mean of; it only keeps the limbs few.
SHIFT_ROWS = 64
_DIGITS = 10**38


def whole(vec: Column) -> Column:
    """floor(256 * c) for each component, as array<long>."""
    return F.transform(vec, lambda c: F.least(F.greatest(F.floor(c.cast("double") * 256), F.lit(-HELD)), F.lit(HELD)))


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as rows of a matrix."""
    return batch.column("x").flatten().to_numpy().reshape(-1, dims)


def cross_products(y: np.ndarray) -> np.ndarray:
    """yᵀy for 64-bit whole numbers, exact, as an array of Python's integers."""
    out = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), ROWS):
        part = y[at : at + ROWS]
        most = max(abs(int(part.min())), abs(int(part.max())))
        count = max(1, -(-(most.bit_length() + 1) // LIMB))
        mask = (1 << LIMB) - 1
        limbs = [((part >> LIMB * k) & mask if k < count - 1 else part >> LIMB * k).astype(np.float64) for k in range(count)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return out


@dataclass(frozen=True)
class Scatter:
    """What is summed over the fit list: the number of vectors, the shift, and sums and cross-products after the shift."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def matrix(self) -> np.ndarray:
        """n·XᵀX - SSᵀ in Python's integers, which the shift leaves as it is."""
        return self.n * self.products - np.outer(self.sums, self.sums)


@dataclass(frozen=True)
class Whitening:
    """Components as columns, by falling eigenvalue; share is each one's part of the whole variance."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    share: np.ndarray


def scatter(fit: DataFrame, dims: int) -> Scatter:
    """The exact sums over ``fit`` (x array<long>, of ``dims`` numbers each)."""
    some = [r.x for r in fit.select("x").limit(SHIFT_ROWS).collect()]
    shift = np.array([sum(c) // len(some) for c in zip(*some, strict=True)], np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            if batch.num_rows:
                y = _rows(batch, dims) - shift
                n, products = n + len(y), products + cross_products(y)
                sums = sums + np.array([sum(map(int, c)) for c in y.T] if np.abs(y).max() > HELD // len(y) else y.sum(axis=0).tolist(), object)
        if n:
            rows = [[str(v) for v in row] for row in products]
            yield pa.record_batch({"i": pa.array(range(dims), pa.int32()), "n": pa.array([n] * dims), "s": pa.array(map(str, sums), pa.string()), "c": pa.array(rows, pa.list_(pa.string()))})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one i follow each other; one is held at a time."""
        held: list | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["i"]:
                    yield from _sent(held)
                    held = [row["i"], 0, 0, [0] * dims]
                held = [held[0], held[1] + row["n"], held[2] + int(row["s"]), [a + int(b) for a, b in zip(held[3], row["c"], strict=True)]]
        yield from _sent(held)

    schema = "i int, n long, s string, c array<string>"
    parts = cut(fit.select("x").mapInArrow(add, schema))
    merged = parts.repartition("i").sortWithinPartitions("i").mapInArrow(merge, schema)
    found = sorted(merged.collect())  # a row a dimension
    return Scatter(found[0].n, shift, np.array([int(r.s) for r in found], object), np.array([[int(v) for v in r.c] for r in found], object))


def _sent(held: list | None) -> Iterator[pa.RecordBatch]:
    if held is not None:
        yield pa.record_batch({"i": pa.array(held[:1], pa.int32()), "n": pa.array([held[1]]), "s": pa.array([str(held[2])]), "c": pa.array([list(map(str, held[3]))], pa.list_(pa.string()))})


def decompose(found: Scatter, k: int) -> Whitening:
    """The k first principal components of the fit list's covariance."""
    exact, square = found.matrix(), found.n * found.n
    covariance = np.array([[int(v) / square for v in row] for row in exact])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    trace = sum(int(exact[i, i]) for i in range(len(exact))) / square
    real = values > len(exact) * np.finfo(float).eps * max(trace, 0.0)
    return Whitening(found.n, found.shift, found.sums, vectors, np.where(real, values, 0.0), np.where(real, values / (trace or 1.0), 0.0))


def project(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """The whitened components of whole-numbered vectors (NaN where a variance is zero), and their exact deviations."""
    y, sums = x - model.shift, model.sums
    reach = model.n * max(1, abs(int(y.min())), abs(int(y.max()))) + max(map(abs, sums))
    if reach * reach * len(sums) < 1 << 63:
        away = model.n * y - sums.astype(np.int64)
        deviation = (away * away).sum(axis=1).tolist()
    else:
        away = model.n * y.astype(object) - sums
        deviation = (away * away).sum(axis=1).tolist()
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.values > 0, 1 / np.sqrt(model.values), np.nan)
        return (away / model.n).astype(np.float64) @ model.vectors * scale, deviation


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 4) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error of every usable vector."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = embeddings.where(grid.usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vec_col)).alias("x")).where(F.size("x") > 0)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    dims = length.d
    rows = rows.where(F.size("x") == dims)
    fit = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).select("x"))
    model = decompose(scatter(fit, dims), k)
    top = len(model.values)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = project(_rows(batch, dims), model)[0]
                yield pa.record_batch({f"w{i}": pa.array(w[:, i]) for i in range(top)})

    real = [i for i in range(top) if model.values[i] > 0]
    pairs = [(i, j) for i in real for j in real if i <= j]
    white = fit.mapInArrow(fitted, ", ".join(f"w{i} double" for i in range(top)))
    error = 0.0
    if pairs:
        covariance = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w, deviation = project(_rows(batch, dims), model)
                m = batch.num_rows
                long = pa.array([v if v < _DIGITS else None for v in deviation], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), top))
                yield pa.record_batch({
                    "vec_id": batch.column("vec_id").take(each),
                    "component": pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * top, model.n, np.int64)),
                    "deviation": long.take(each),
                    "whitened": pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    "explained": pa.array(np.tile(model.share, m)),
                    "identity_error": pa.array(np.full(m * top, error)),
                })

    return rows.mapInArrow(final, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE: dict[str, str] = {}
