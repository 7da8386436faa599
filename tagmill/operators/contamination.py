"""Passages of an evaluation set inside a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_shingles(text: Column, width: int) -> Column:
    """Hashes of a text's runs of ``width`` words; an empty array if it has fewer."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    none = F.slice(F.array(F.lit(0).cast("long")), 1, 0)
    hashed = F.transform(words, lambda w: F.xxhash64(w))  # each word once
    return F.get(F.transform(F.array(hashed), lambda w: F.when(F.size(w) >= width, runs(w)).otherwise(none)), F.lit(0))


def contamination(docs: DataFrame, items: DataFrame, width: int = 8, share: float = 0.5) -> DataFrame:
    """item_id, n_docs, first_doc: items of which some document holds ``share`` or more of the distinct shingles.

    The items' shingles are the small side of an equi-join; documents are cut to the few shingles that match before any
    aggregation, and no join is between documents.
    """
    wanted = items.select("item_id", F.explode(F.array_distinct(word_shingles(F.col("text"), width))).alias("h"))
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    found = docs.select("doc_id", F.explode(word_shingles(F.col("text"), width)).alias("h")).join(wanted, "h")
    hits = found.groupBy("item_id", "doc_id").agg(F.countDistinct("h").alias("n")).join(sizes, "item_id").where(F.col("n") >= share * F.col("size"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))
