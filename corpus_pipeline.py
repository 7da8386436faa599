"""A training corpus from the table ``documents``: grade, remove repeated lines, deduplicate, mix, tokenize."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import lines, minhash, mixing, pieces, quality
from tagmill.llm.common import new_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grade_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal classifier selects: the most probable grade is the highest.

    A null or empty text has no sign of a low grade and is kept; rows that repeat are graded alike; without labels all are
    kept; an empty table stays empty.
    """
    graded = quality.graded_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return graded.where("keep").select(COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that stand in an earlier one; those that were nothing else go.

    Null and empty texts, and texts of blanks, stay; rows that repeat both id and text are treated alike; n_chars follows a
    text that changes, and is left as it is otherwise, null included.
    """
    out = lines.dedup_chunks(docs.select(COLUMNS)).where("_n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one of rows that repeat an id and a text.

    Null and empty texts are linked with nothing and stay, as one row for each id and text. Rows with a null id stay one for
    each text, but for copies and near copies of identified documents, which go. Of rows that repeat id and text the one with
    the least source, lang and n_chars stays; texts are compared whole. An empty table stays empty.
    """
    docs = docs.select(COLUMNS)
    marks = minhash.near_duplicates(docs, marked=True).groupBy("doc_id", "mark").agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_rows"))
    marks = marks.where("_kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_rows")
    kept = docs.join(marks, docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")))
    several = kept.where("_rows > 1").groupBy("doc_id", "text").agg(F.min(F.struct("source", "lang", "n_chars")).alias("_first"))  # copies meet before they are shuffled
    return kept.where("_rows = 1").select(COLUMNS).unionByName(several.select("doc_id", "text", "_first.lang", "_first.source", "_first.n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    Null and empty texts have size 0 and come along as their hash decides; null sources are one source; rows of one id are
    taken alike, by its hash; ties at the border too.
    """
    return mixing.mixed_documents(docs.select(COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and the text that they spell: null becomes empty, and U+2581 a space."""
    coded = pieces.encode_pieces(docs.select("doc_id", "source", "lang", "text"), pieces.model_path(), spelled_col="_spelled")
    return coded.withColumn("text", F.col("_spelled")).drop("_spelled").withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [("quality", grade_documents), ("lines", remove_lines), ("near_duplicates", drop_near_duplicates), ("mix", mix), ("tokenize", tokenize)]

#: The first stage's learned selection can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
