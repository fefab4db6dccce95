"""Application records in JSON, images beside them, and what leaves the engine: results, template and response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators.comparison import FIELDS
from docproof.sources.images import HEADER, image_header
from docproof.sources.manifest import COLUMNS, write_results

#: Image types, and the bounds of an upload.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
MOST_BYTES, MOST_SIDE, MOST_PIXELS = 10 * 1024 * 1024, 12_000, 40_000_000
#: Columns of the results file and the example row of the template.
RESULT_COLUMNS = [
    "image_filename", "brand_name", "overall_status", *(f"{f}_status" if f != "brand_name" else "brand_status" for f in FIELDS),
    "government_warning_status", "automated_warning_status", "manual_physical_confirmation_required", "duration_ms", "error",
]
EXAMPLE = ("example-label.jpg", "Stone's Throw", "Kentucky Straight Bourbon Whiskey", "45", "750 mL", "Example Distillery LLC", "Louisville, KY", "false", "")
RECORD = "brand_name string, brand string, class_type string, abv string, net_contents string, producer_name string, producer_address string, imported_product variant, imported variant, country_origin string, country_of_origin string"
REQUIRED = [f for f in FIELDS if f != "country_origin"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Applications from JSON files, one object each, with the older names, and errors, all that hold for a row.

    A flag must be a JSON boolean: text that says true is none. A field that is missing or null is an error; only
    imported products keep an origin.
    """
    rows = spark.read.schema(RECORD).option("multiLine", True).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    given = F.coalesce("imported_product", "imported")
    flag = F.when(F.schema_of_variant(given) == "BOOLEAN", F.try_variant_get(given, "$", "boolean"))
    names = {"brand_name": F.coalesce("brand_name", "brand"), "country_origin": F.coalesce("country_origin", "country_of_origin")}
    fields = [names.get(f, F.col(f)).alias(f) for f in FIELDS if f not in ("abv", "country_origin")]
    missing = [F.when(names.get(f, F.col(f)).isNull(), F.lit(f"{f} is missing")) for f in REQUIRED]
    errors = F.array_compact(F.array(F.when(flag.isNull(), F.lit("imported_product must be true or false")), *missing))
    read = rows.select("path", *fields, F.col("abv").try_cast("double").alias("abv"), flag.alias("imported_product"), F.when(flag, names["country_origin"]).alias("country_origin"), errors.alias("errors"))
    return read.withColumn("error", F.get("errors", F.lit(0)))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*\z", "")


def paired(images: DataFrame, records: DataFrame) -> DataFrame:
    """(image, record): images(path) with the record(path) of their stem, else with that of the part before the first underscore; others are left out; by image."""
    known = records.select(stem(F.col("path")).alias("stem"), F.col("path").alias("record"))
    own = images.select(F.col("path").alias("image"), stem(F.col("path")).alias("whole")).withColumn("prefix", F.substring_index("whole", "_", 1))
    both = own.join(known.withColumnsRenamed({"stem": "whole", "record": "same"}), "whole", "left").join(known.withColumnsRenamed({"stem": "prefix", "record": "near"}), "prefix", "left")
    return both.select("image", F.coalesce("same", "near").alias("record")).where("record is not null").orderBy("image")


def media_type(declared: Column) -> Column:
    """A declared type without its parameters, if it is one of the three."""
    plain = F.lower(F.trim(F.substring_index(declared, ";", 1)))
    return F.when(plain.isin(*set(MEDIA_TYPES.values())), plain)


def sniffed_type(content: Column) -> Column:
    """The image type that the first bytes show."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe(F.lit("57454250")), "image/webp")


def size_errors(width: Column, height: Column) -> Column:
    return F.when((width <= 0) | (height <= 0), "empty image").when(F.greatest(width, height) > MOST_SIDE, "a side is too long").when(width.cast("bigint") * height > MOST_PIXELS, "too many pixels")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, media_type, width, height, error): images of a folder, checked by their bytes; content stays on the executors, and that of larger files is not read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    named = F.try_element_at(names, F.lower(F.substring_index("path", ".", -1)))
    kinds = HEADER.simpleString()
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "length", image_header("content").alias("h"))
    large = files.where(F.col("length") > MOST_BYTES).select("path", "length", F.lit(None).cast(kinds).alias("h"))
    h = F.col("h")
    error = (
        F.when(named.isNull(), "not a PNG, JPEG or WebP image")
        .when(F.col("length") > MOST_BYTES, "larger than 10 MB")
        .when(~h.media_type.eqNullSafe(named), "content is not of the declared type")
        .when(h.width.isNull() | h.height.isNull(), "not a readable image")
        .when(h.frames != 1, "animated images are not supported")
        .otherwise(F.coalesce(size_errors(h.width, h.height), F.when(~h.complete, "not a readable image")))
    )
    return small.unionByName(large).select("path", F.col("length").alias("bytes"), h.media_type.alias("media_type"), h.width.alias("width"), h.height.alias("height"), error.alias("error"))


def export_status(status: Column) -> Column:
    return F.when(status == "invalid", "validation_error").otherwise(status)


def results_table(items: DataFrame, results: DataFrame, warnings: DataFrame) -> DataFrame:
    """The 15 columns of the results file, in order of the rows, from items(doc_id, row_number, image_filename, brand_name, status, duration_ms, error), results and warnings(doc_id, overall_status, automated_status, manual_confirmation_required)."""
    status = results.groupBy("doc_id").pivot("field", FIELDS).agg(F.first("status")).select("doc_id", *(F.col(f).alias("brand_status" if f == "brand_name" else f"{f}_status") for f in FIELDS))
    named = warnings.select("doc_id", F.col("overall_status").alias("government_warning_status"), F.col("automated_status").alias("automated_warning_status"), F.col("manual_confirmation_required").cast("string").alias("manual_physical_confirmation_required"))
    whole = items.withColumn("overall_status", export_status(F.col("status"))).withColumn("duration_ms", F.round("duration_ms").cast("long").cast("string"))
    whole = whole.join(status, "doc_id", "left").join(named, "doc_id", "left").orderBy("row_number")
    return whole.select(*(T.escaped_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in RESULT_COLUMNS))


def write_template(spark: SparkSession, path: str) -> None:
    """The manifest's header with one example row."""
    write_results(spark.createDataFrame([EXAMPLE], ", ".join(f"{c} string" for c in COLUMNS)).coalesce(1), path)


def responses(results: DataFrame, overall: DataFrame) -> DataFrame:
    """(doc_id, response): one JSON object for each document with its fields and summary."""
    field = F.struct("status", "expected_raw", "extracted_raw", "similarity_score", "evidence")
    fields = results.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", field)))).alias("results"))
    return fields.join(overall, "doc_id").select("doc_id", F.to_json(F.struct("overall_status", "summary", "results")).alias("response"))
