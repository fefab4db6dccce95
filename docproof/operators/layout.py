"""Lines and panels from word boxes: words(doc_id, ordinal, page, block, paragraph, line, left, top, width, height, confidence, text).

Words are in order of (left, ordinal) within a line; ordinal is unique in a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions import text as T

BOX = ("left", "top", "width", "height")
LINE = ["doc_id", "page", "block", "paragraph", "line"]


def split_lines(words: DataFrame) -> DataFrame:
    """Adds segment to words with image_width: a line breaks where the gap exceeds 3.5 median heights and 8 % of the image; a word without any ids is a line of its own. One shuffle, by line."""
    whole, order = Window.partitionBy(*LINE), Window.partitionBy(*LINE).orderBy("left", "ordinal")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order)
    measured = words.select("*", gap.alias("_gap"), F.percentile("height", 0.5).over(whole).alias("_height"), F.bool_and(F.col("left").isNotNull()).over(whole).alias("_boxed"))
    wide = F.col("_boxed") & (F.col("_gap") > F.greatest(3.5 * F.col("_height"), 0.08 * F.col("image_width")))
    parted = measured.withColumn("_wide", F.coalesce(wide, F.lit(False)).cast("int"))
    alone = F.coalesce(*(F.col(c).cast("string") for c in LINE[1:])).isNull()
    return parted.withColumn("segment", F.when(alone, F.col("ordinal").cast("bigint")).otherwise(F.sum("_wide").over(order))).drop("_wide", "_height", "_boxed", "_gap")


def lines_from(words: DataFrame) -> DataFrame:
    """One row for each segment of a line: its words and their text in order, union box, mean confidence, median height."""
    word = F.struct("left", "ordinal", "text", "top", "width", "height", "confidence", "page")
    return words.groupBy(*LINE, "segment").agg(F.array_sort(F.collect_list(word)).alias("words"), *_of_words()).withColumn("text", F.array_join("words.text", " "))


def _of_words() -> list[Column]:
    return [
        F.min("left").alias("left"), F.min("top").alias("top"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"), (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        F.avg("confidence").alias("mean_confidence"), F.median("height").alias("median_height"), F.min("ordinal").alias("first"), F.count("*").alias("n_words"), F.max("image_width").alias("image_width"),
    ]


def panels(lines: DataFrame) -> DataFrame:
    """Adds panel_id (boundaries to the left of a line; null below four lines) and sequence_number in reading order; lines have image_width."""
    at = ["first", *LINE[1:], "segment"]  # words may share an ordinal, segments none of these
    own, by_left = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("left", *at)
    before, behind = by_left.rowsBetween(Window.unboundedPreceding, -1), by_left.rowsBetween(0, Window.unboundedFollowing)
    measured = lines.select(
        "*", F.count("*").over(own).alias("_n"), F.row_number().over(by_left).alias("_at"), (F.col("left") - F.lag("left").over(by_left)).alias("_gap"),
        F.percentile(F.col("left") + F.col("width"), 0.5).over(before).alias("_right"), F.percentile("left", 0.5).over(behind).alias("_left"),
    )
    boundary = (F.col("_gap") >= 0.12 * F.col("image_width")) & (F.col("_at") > 2) & (F.col("_at") <= F.col("_n") - 1) & (F.col("_right") <= F.col("_left") + 0.05 * F.col("image_width"))
    counted = measured.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int"))
    placed = counted.withColumn("panel_id", F.when(F.col("_n") >= 4, F.sum("_b").over(by_left)).cast("int"))
    reading = Window.partitionBy("doc_id").orderBy(F.col("panel_id").asc_nulls_last(), F.col("top").asc_nulls_last(), F.col("left").asc_nulls_last(), *at)
    return placed.withColumn("sequence_number", F.row_number().over(reading)).drop("_n", "_at", "_gap", "_right", "_left", "_b", "image_width")


def read_lines(words: DataFrame) -> DataFrame:
    """The lines of labels as the rules take them, from words that also have image_width and image_height: doc_id, line_number, text, box, panel_id, line_height, mean_confidence, image sizes and words."""
    sizes = words.groupBy("doc_id").agg(F.max("image_height").alias("image_height"), F.max("image_width").alias("image_width"))
    placed = panels(lines_from(split_lines(words))).join(sizes, "doc_id")
    return placed.select("doc_id", F.col("sequence_number").alias("line_number"), "text", *BOX, "panel_id", F.col("median_height").alias("line_height"), "mean_confidence", "image_width", "image_height", "words")


def spoken(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the words of each line joined by spaces, lines in order of their first word, one below the other."""
    order = F.struct("left", "ordinal", "text")
    lined = words.groupBy(*keys, *LINE[1:]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda w: w.text), " ").alias("t"), F.min("ordinal").alias("o"))
    return lined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda l: l.t), "\n").alias("text"))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    boxes = F.filter(boxes, lambda b: b.left.isNotNull())
    left, top = F.array_min(F.transform(boxes, lambda b: b.left)), F.array_min(F.transform(boxes, lambda b: b.top))
    right, bottom = F.array_max(F.transform(boxes, lambda b: b.left + b.width)), F.array_max(F.transform(boxes, lambda b: b.top + b.height))
    return F.when(F.size(boxes) > 0, F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")))


def nearest_other(words: DataFrame, region: DataFrame) -> DataFrame:
    """(doc_id, distance): the gap between the box around a region(doc_id, ordinal) and the nearest other word.

    Each document has one box, so every word is compared once; null where a document has no other word.
    """
    boxed = words.where("left is not null")
    inner = boxed.join(region, ["doc_id", "ordinal"], "left_semi").groupBy("doc_id").agg(
        F.min("left").alias("_l"), F.min("top").alias("_t"), F.max(F.col("left") + F.col("width")).alias("_r"), F.max(F.col("top") + F.col("height")).alias("_b")
    )
    around = inner.select("doc_id", F.struct(F.col("_l").alias("left"), F.col("_t").alias("top"), (F.col("_r") - F.col("_l")).alias("width"), (F.col("_b") - F.col("_t")).alias("height")).alias("box"))
    outer = boxed.join(region, ["doc_id", "ordinal"], "left_anti").select("doc_id", F.struct(*BOX).alias("other"))
    return around.join(outer, "doc_id", "left").groupBy("doc_id").agg(F.min(F.when(F.col("other").isNotNull(), T.box_distance(F.col("box"), F.col("other")))).alias("distance"))
