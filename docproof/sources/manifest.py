"""Sources: manifest CSV files with validated rows, OCR word tables from TSV, and result export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docproof.functions import text as T

COLUMNS = ["image_filename", "brand_name", "class_type", "abv", "net_contents", "producer_name", "producer_address", "imported_product", "country_origin"]
MOST_ROWS = 300


class ManifestError(ValueError):
    """The file as a whole is rejected."""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows as strings with row_number (the header is row 1) and parse_error; rows of blanks alone are skipped."""
    header = spark.read.option("multiLine", True).option("escape", '"').csv(path).first()
    names = [(h or "").strip().lstrip("﻿") for h in header] if header else []
    missing, unexpected = [c for c in COLUMNS if c not in names], [n for n in names if n not in COLUMNS]
    if missing or unexpected or len(set(names)) != len(names):
        raise ManifestError(f"missing columns {missing}, unexpected columns {unexpected}, or one stands twice")
    schema = ", ".join(f"`{n}` string" for n in names) + ", parse_error string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "parse_error").csv(path)
    filled = rows.where(F.coalesce(*(F.when(F.trim(c) != "", F.lit(1)) for c in [*names, "parse_error"])).isNotNull())
    numbered = filled.withColumn("_at", F.monotonically_increasing_id())
    if len(numbered.take(MOST_ROWS + 1)) > MOST_ROWS:
        raise ManifestError(f"more than {MOST_ROWS} rows")
    order = F.row_number().over(Window.orderBy("_at"))  # at most MOST_ROWS rows
    return numbered.withColumn("row_number", order + 1).drop("_at")


def errors_of(rows: DataFrame) -> DataFrame:
    """Adds errors, all that hold for a row, in a fixed order; a faulty row stops no other."""
    required = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is required")) for c in COLUMNS[:8] if c != "imported_product"]
    flag, given = F.lower(F.trim("imported_product")), F.coalesce(F.trim("country_origin"), F.lit("")) != ""
    checks: list[Column] = [
        *required,
        F.when((F.trim("abv") != "") & T.abv(F.col("abv")).isNull(), F.lit("abv must be over 0 and at most 100")),
        F.when((F.trim("net_contents") != "") & T.volume(F.col("net_contents")).isNull(), F.lit("net_contents must be a number and a unit")),
        F.when(F.coalesce(flag, F.lit("")).isin("true", "false"), F.lit(None)).otherwise(F.lit("imported_product must be true or false")),
        F.when((flag == "true") & ~given, F.lit("country_origin is required for imported products")),
    ]
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def flag_duplicates(rows: DataFrame, name: str = "image_filename") -> DataFrame:
    """Adds file_key and duplicate: every row of a key that stands twice. Keys are counted before they meet the rows."""
    keyed = rows.withColumn("file_key", T.filename_key(F.col(name)))
    twice = keyed.groupBy("file_key").agg((F.count("*") > 1).alias("duplicate"))
    return keyed.join(twice.withColumnRenamed("file_key", "_key"), F.col("file_key").eqNullSafe(F.col("_key"))).drop("_key")


def map_files(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows(file_key) with n_files and the file where it is one; and the files that no row names."""
    found = files.withColumn("file_key", T.filename_key(F.col("name"))).groupBy("file_key").agg(F.count("*").alias("n_files"), F.min("name").alias("file"))
    mapped = rows.join(found, "file_key", "left")
    status = F.when(F.col("n_files").isNull(), "missing").when(F.col("n_files") > 1, "multiple").otherwise("ready")
    mapped = mapped.withColumn("file_status", status).withColumn("n_files", F.coalesce("n_files", F.lit(0))).withColumn("file", F.when(F.col("n_files") == 1, F.col("file")))
    unmatched = files.withColumn("file_key", T.filename_key(F.col("name"))).join(rows.select("file_key"), "file_key", "left_anti")
    return mapped, unmatched


TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


class WordsError(ValueError):
    """The word table has no text column."""


def check_words_header(spark: SparkSession, path: str) -> None:
    """Every file's first row must name a text column; the rows of a file's first block decide, in their order."""
    rows = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    first = rows.groupBy("path").agg(F.min_by("value", "at").alias("header"))
    wrong = first.where(~F.array_contains(F.split("header", "\t"), "text")).orderBy("path").first()
    if wrong is not None:
        raise WordsError(f"no column named text in {wrong.path}")


def raw_text(words: DataFrame) -> DataFrame:
    """(path, text): words of a line joined by spaces, lines in order of their first word, one below the other."""
    line = words.groupBy("path", "page_num", "block_num", "par_num", "line_num").agg(F.min("ordinal").alias("first"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("w"))
    line = line.select("path", "first", F.array_join(F.transform("w", lambda w: w.text), " ").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "text")))
    return line.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("text"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of OCR TSV files: path, ordinal, ids, box, confidence (0 to 1, null if negative) and text."""
    check_words_header(spark, path)
    rows = spark.read.schema(TSV).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("ordinal"))
    words = rows.where((F.col("level") == 5) & (F.trim("text") != ""))
    box = F.struct("left", "top", "width", "height").alias("box")
    return words.select("path", "ordinal", "page_num", "block_num", "par_num", "line_num", "word_num", box, F.when(F.col("conf") >= 0, F.col("conf") / 100).alias("confidence"), "text")


def results_for_export(results: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns safe for spreadsheets, to be written by write_results."""
    return results.select(*(T.escaped_cell(F.col(c).cast("string")).alias(c) for c in columns))


def write_results(results: DataFrame, path: str) -> None:
    results.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)
