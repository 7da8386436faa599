"""Label lines to boxes: four readers that differ in what they let pass, and the strict reader's findings.

Input is ``schemas.LABEL_LINES`` (image_id, line_no from 1, line). All rules are column expressions over the split line,
so a scan, its rules and the filter form one stage; only the check for repeated boxes needs a shuffle by image.
Numbers are plain decimals; ``nan``, ``inf`` and digits with underscores are not taken for numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.geometry import EPS, box_key, overflows, to_pixels

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"


def tokens(line: Column) -> Column:
    """The line's parts between white space; an empty array for blank lines."""
    return F.array_remove(F.split(line, r"\s+"), "")


def number(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def _numbered(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank, with their parts t and the first five as numbers.

    A filter on a column is pushed below it and computes it again for each place that names it. One on what a generator
    gives stays above, so a line is split and its numbers are read once.
    """
    rows = lines.withColumn("t", F.explode(F.array(tokens(F.col("line"))))).where(F.size("t") > 0)
    numbers = F.struct(*[number(F.get("t", F.lit(i))).alias(k) for i, k in enumerate(("c", "cx", "cy", "w", "h"))])
    return rows.select("*", F.inline(F.array(numbers)))


def parse_strict(lines: DataFrame, n_classes: int = 0, least_area: float = 0.0002) -> DataFrame:
    """Every line that isn't blank: image_id, line_no, cls, cx, cy, w, h, kept, errors, warns.

    The rules apply in order, and most errors end a line's inspection: number of columns (5, or 6 with a warning),
    numbers, class id, class below ``n_classes`` (0: any; the box is kept), coordinates within 0 to 1, size above 0. Boxes
    that leave the image, are smaller than ``least_area`` or repeat an earlier one of the image are warned about.
    """
    n = F.size("t")
    wrong_columns = ~n.isin(5, 6)
    numbers = F.col("c").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    bad_class = (F.col("c") != F.floor("c")) | (F.col("c") < 0)
    outside = (F.least("cx", "cy", "w", "h") < -EPS) | (F.greatest("cx", "cy", "w", "h") > 1 + EPS)
    flat = (F.col("w") <= 0) | (F.col("h") <= 0)
    stop = F.when(wrong_columns, "columns").when(~numbers, "not a number").when(bad_class, "class id").when(outside, "coordinates").when(flat, "empty box")
    rows = _numbered(lines).withColumn("stop", stop)
    fine_class = ~wrong_columns & numbers & ~bad_class
    high = F.when(fine_class & (F.lit(n_classes) > 0) & (F.col("c") >= n_classes), "class range")
    rows = rows.withColumn("kept", F.col("stop").isNull()).withColumn("cls", F.when(fine_class, F.col("c").cast("int")))
    key = F.when(F.col("kept"), box_key(F.col("cls"), *[F.col(k) for k in ("cx", "cy", "w", "h")]))
    before = W.partitionBy("image_id", key).orderBy("line_no")
    again = F.col("kept") & (F.row_number().over(before) > 1)
    warns = [
        F.when((n == 6), "confidence column"),
        F.when(F.col("kept") & overflows(*[F.col(k) for k in ("cx", "cy", "w", "h")]), "leaves image"),
        F.when(F.col("kept") & (F.col("w") * F.col("h") < least_area), "tiny"),
        F.when(again, "repeated"),
    ]
    return rows.select("image_id", "line_no", "cls", "cx", "cy", "w", "h", "kept", F.array_compact(F.array(high, "stop")).alias("errors"), F.array_compact(F.array(*warns)).alias("warns"))


def parse_lenient(lines: DataFrame) -> DataFrame:
    """Boxes of lines with five numbers or more and a size above 0; classes are truncated, nothing else is checked."""
    rows = _numbered(lines).where((F.size("t") >= 5) & F.col("c").isNotNull() & F.col("cx").isNotNull() & F.col("cy").isNotNull() & (F.col("w") > 0) & (F.col("h") > 0))
    return rows.select("image_id", "line_no", F.col("c").cast("int").alias("cls"), "cx", "cy", "w", "h")


def parse_editor(lines: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Boxes of lines with exactly five parts and a whole class, in whole pixels (truncated)."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    fit = (F.size("t") == 5) & F.get("t", F.lit(0)).rlike(INTEGER) & F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    corners = to_pixels(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), w, h)
    return _numbered(lines).where(fit).select("image_id", "line_no", F.get("t", F.lit(0)).cast("int").alias("cls"), *[x.alias(k) for k, x in corners.items()])


def parse_merge(lines: DataFrame) -> DataFrame:
    """image_id, line_no, src_cls (null: an error) and the rest of the line as it stands."""
    rows = _numbered(lines)
    return rows.select("image_id", "line_no", F.col("c").cast("int").alias("src_cls"), F.array_join(F.slice("t", 2, F.greatest(F.lit(1), F.size("t"))), " ").alias("rest"))


def rule_counts(parsed: DataFrame) -> DataFrame:
    """level, rule, n over a strict reading."""
    both = F.concat(F.transform("errors", lambda x: F.struct(F.lit("error").alias("level"), x.alias("rule"))), F.transform("warns", lambda x: F.struct(F.lit("warning").alias("level"), x.alias("rule"))))
    return parsed.select(F.inline(both)).groupBy("level", "rule").agg(F.count(F.lit(1)).alias("n"))


def infer_classes(boxes: DataFrame) -> DataFrame:
    """cls, name: class_0 up to the largest id seen."""
    top = boxes.agg(F.max("cls").alias("top")).where("top >= 0")
    return top.select(F.explode(F.sequence(F.lit(0), "top")).alias("cls")).select("cls", F.concat(F.lit("class_"), F.col("cls").cast("string")).alias("name"))


def seen_classes(boxes: DataFrame) -> DataFrame:
    """cls, name: the ids that occur."""
    return boxes.select("cls").distinct().select("cls", F.concat(F.lit("sinif_"), F.col("cls").cast("string")).alias("name"))
