"""Held-out crops: parts of images that a JSON file names, and the words that stand in them.

A file is one object whose list ``heldout`` has objects with name, source (a URL or path of an image) and crop, the
corners [left, top, right, bottom] in pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.operators import comparison, layout, warning

EVIDENCE = "heldout array<struct<name:string,source:string,crop:array<int>>>"
#: Fixed value: the volume in mL taken for crops whose container is not known; it decides no check.
ANY_VOLUME = 750
#: Side of a tile of the page, in pixels.
TILE = 256
_BOX = ("left", "top", "width", "height")


def image_of(source: Column) -> Column:
    """The file name of a URL or path, without query and fragment."""
    return F.regexp_extract(F.regexp_extract(source, r"\A[^?#]*", 0), r"[^/]*\z", 0)


def crops(documents: DataFrame, evidence: str = "evidence") -> DataFrame:
    """(path, position, name, image, left, top, width, height, error): a row for each crop of documents(path, evidence), by position from 0; a file without any has one row with an error.

    Null or broken JSON, a crop without a name or source, with other than four numbers or with no area are errors of
    their row; other crops of the file stay.
    """
    parsed = documents.select("path", F.from_json(evidence, EVIDENCE).alias("e"))
    each = parsed.select("path", F.posexplode_outer("e.heldout").alias("position", "c"))
    corner = [F.get("c.crop", F.lit(k)) for k in range(4)]
    complete = (F.size("c.crop") == 4) & ~F.exists("c.crop", lambda x: x.isNull())
    error = (
        F.when(F.col("c").isNull(), "no crop")
        .when(F.coalesce(F.trim("c.name"), F.lit("")) == "", "name is missing")
        .when(F.coalesce(image_of(F.col("c.source")), F.lit("")) == "", "source is missing")
        .when(~F.coalesce(complete, F.lit(False)), "crop must be four numbers")
        .when((corner[2] <= corner[0]) | (corner[3] <= corner[1]), "crop is empty")
    )
    return each.select("path", "position", F.col("c.name").alias("name"), image_of(F.col("c.source")).alias("image"), corner[0].alias("left"), corner[1].alias("top"), (corner[2] - corner[0]).alias("width"), (corner[3] - corner[1]).alias("height"), error.alias("error"))


def read_crops(spark: SparkSession, path: str) -> DataFrame:
    """The crops of JSON files, one object each."""
    files = spark.read.text(path, wholetext=True)
    return crops(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("evidence")))


def words_in(regions: DataFrame, words: DataFrame) -> DataFrame:
    """The words of crops: words(doc_id, ..) whose centres lie in regions(doc_id, crop, left, top, width, height), as words of their own small image.

    doc_id is the crop then, boxes are cut to it and counted from its corner, sizes of the image are the crop's. Both
    sides are keyed by tiles of the page: a word has one, a crop those that it covers, so a page with very many words
    or crops is spread over tasks, and no word meets a crop twice.
    """
    spread = lambda at, size: F.sequence(F.floor(F.col(at) / TILE), F.floor((F.col(at) + F.col(size)) / TILE))
    region = regions.where("width > 0 and height > 0").select(F.col("doc_id").alias("_doc"), F.col("crop").alias("_crop"), *(F.col(c).alias(f"_{c}") for c in _BOX))
    region = region.withColumn("_tx", F.explode(spread("_left", "_width"))).withColumn("_ty", F.explode(spread("_top", "_height")))
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    met = words.where("left is not null").withColumns({"_x": x, "_y": y}).join(region, (F.col("doc_id") == F.col("_doc")) & (F.floor(F.col("_x") / TILE) == F.col("_tx")) & (F.floor(F.col("_y") / TILE) == F.col("_ty")))
    inside = (F.col("_x") >= F.col("_left")) & (F.col("_x") < F.col("_left") + F.col("_width")) & (F.col("_y") >= F.col("_top")) & (F.col("_y") < F.col("_top") + F.col("_height"))
    moved = {}
    for at, size in (("left", "width"), ("top", "height")):
        start = F.greatest(F.col(at) - F.col(f"_{at}"), F.lit(0))
        moved |= {at: start.cast("int"), size: (F.least(F.col(at) + F.col(size) - F.col(f"_{at}"), F.col(f"_{size}")) - start).cast("int")}
    moved |= {"doc_id": F.col("_crop"), "image_width": F.col("_width"), "image_height": F.col("_height")}
    return met.where(inside).withColumns(moved).select(*words.columns)


def checked(regions: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, check, status, note): the warning's checks of each crop; one without words has no warning."""
    held = words_in(regions, words)
    every = regions.select(F.col("crop").alias("doc_id")).distinct()
    texts = every.join(layout.spoken(held, "doc_id"), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return warning.analyse(held, every.withColumn("ml", F.lit(ANY_VOLUME).cast("double")), texts=texts)


def report(groups: DataFrame, checks: DataFrame) -> DataFrame:
    """Counts of each check's statuses, and of the worst of each crop, by group of groups(doc_id, group)."""
    return comparison.grouped_status_counts(checks.join(groups, "doc_id"), ["group"])
