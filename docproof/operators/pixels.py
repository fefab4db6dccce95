"""Measures of gray pixels, one row for each: pixels(crop, x, y, level), level from 0 to 255. Crops are small rectangles without gaps.

``crops`` cuts them out of pages. Otsu's threshold and percentiles come from histograms, at most 256 rows for a crop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the weight and contrast checks.
LEAST_SPREAD, DENSITY, LEAST_HEIGHT, HEAVIER, LIGHTER = 76, (0.02, 0.7), 9, 1.2, 0.85


#: Side of a tile, and bounds of a word whose contrast is sampled: its least height, letters of its first word, margin as a share of its height and at least.
TILE, SAMPLED_HEIGHT, SAMPLED_LETTERS, PAD, LEAST_PAD = 64, 12, 3, 0.2, 2


def crops(page_pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """(crop, x, y, level): the pixels of page_pixels(doc_id, x, y, level) that lie in boxes(doc_id, crop, left, top, width, height).

    Both sides are keyed by tiles of the page, so a pixel meets the boxes of its tile and not all of its page's.
    """
    spread = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / TILE), F.floor((F.col(at) + F.col(size) - 1) / TILE)))
    kept = boxes.where("width > 0 and height > 0").select(F.col("doc_id").alias("_doc"), "crop", *(F.col(c).alias(f"_{c}") for c in ("left", "top", "width", "height")), spread("left", "width").alias("_tx"), F.lit(0).alias("_z"))
    kept = kept.withColumn("_ty", F.explode(F.sequence(F.floor(F.col("_top") / TILE), F.floor((F.col("_top") + F.col("_height") - 1) / TILE)))).drop("_z")
    tiled = page_pixels.withColumns({"_px": F.floor(F.col("x") / TILE), "_py": F.floor(F.col("y") / TILE)})
    met = tiled.join(kept, (F.col("doc_id") == F.col("_doc")) & (F.col("_px") == F.col("_tx")) & (F.col("_py") == F.col("_ty")))
    inside = (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_left") + F.col("_width")) & (F.col("y") >= F.col("_top")) & (F.col("y") < F.col("_top") + F.col("_height"))
    return met.where(inside).select("crop", "x", "y", "level")


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("crop", "level").count()


def percentiles(pixels: DataFrame, *shares: float) -> DataFrame:
    """(crop, p<percent> ...): per share the first level with more than that share of the pixels at or below it, else 255."""
    whole, upto = Window.partitionBy("crop"), Window.partitionBy("crop").orderBy("level")
    summed = histogram(pixels).select("crop", "level", F.sum("count").over(upto).alias("below"), F.sum("count").over(whole).alias("n"))
    return summed.groupBy("crop").agg(*(F.coalesce(F.min(F.when(F.col("below") > F.col("n") * q, F.col("level"))), F.lit(255)).alias(f"p{round(100 * q)}") for q in shares))


def otsu(pixels: DataFrame) -> DataFrame:
    """(crop, threshold): the level that parts the pixels with the largest variance between classes, the first of equals; 127 where there is one level only."""
    whole, upto = Window.partitionBy("crop"), Window.partitionBy("crop").orderBy("level")
    mass = F.col("level") * F.col("count")
    summed = histogram(pixels).select(
        "crop", "level", F.sum("count").over(upto).cast("double").alias("w"), F.sum(mass).over(upto).cast("double").alias("s"), F.sum("count").over(whole).cast("double").alias("n"), F.sum(mass).over(whole).cast("double").alias("t")
    )
    apart = F.col("s") / F.col("w") - (F.col("t") - F.col("s")) / (F.col("n") - F.col("w"))
    variance = F.when(F.col("w") < F.col("n"), F.col("w") * (F.col("n") - F.col("w")) * apart * apart)
    best = summed.withColumn("v", variance).groupBy("crop").agg(F.max_by("level", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("level")))).alias("threshold"))
    return best.select("crop", F.coalesce("threshold", F.lit(127)).alias("threshold"))


def perimeters(mask: DataFrame) -> DataFrame:
    """(crop, area, n, perimeter) of mask(crop, x, y, on): edges between a pixel that is on and one that is off or outside."""
    row, column = Window.partitionBy("crop", "y").orderBy("x"), Window.partitionBy("crop", "x").orderBy("y")
    off = [~F.coalesce(f("on").over(w), F.lit(False)) for w in (row, column) for f in (F.lag, F.lead)]
    edges = sum((o.cast("int") for o in off), F.lit(0))
    counted = mask.withColumn("edges", F.when(F.col("on"), edges).otherwise(0))
    return counted.groupBy("crop").agg(F.count_if("on").alias("area"), F.count("*").alias("n"), F.sum("edges").alias("perimeter"))


def ink(pixels: DataFrame, of_equals: str = "dark") -> DataFrame:
    """mask(crop, x, y, on): the smaller class on either side of the threshold is ink; of equal ones the dark or the light one."""
    parted = pixels.join(otsu(pixels), "crop").withColumn("dark", F.col("level") <= F.col("threshold"))
    n_dark, n = F.count_if("dark").over(Window.partitionBy("crop")), F.count("*").over(Window.partitionBy("crop"))
    few = 2 * n_dark <= n if of_equals == "dark" else 2 * n_dark < n
    return parted.select("crop", "x", "y", (F.col("dark") == few).alias("on"))


def weights(pixels: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, heading, stroke, density, height) by part of the statement, from words(crop, doc_id, heading, width, height): medians over words with clear tones; null for fewer than two."""
    clear = percentiles(pixels, 0.1, 0.9).where(F.col("p90") - F.col("p10") >= LEAST_SPREAD).select("crop")
    fit = words.where("width >= 3 and height >= 3").join(clear, "crop", "left_semi")
    shape = perimeters(ink(pixels.join(fit.select("crop"), "crop", "left_semi"))).withColumn("density", F.col("area") / F.col("n"))
    shape = shape.where((F.col("density") >= DENSITY[0]) & (F.col("density") <= DENSITY[1]) & (F.col("perimeter") > 0))
    each = words.select("crop", "doc_id", "heading", "height").join(shape.withColumn("stroke", 2 * F.col("area") / F.col("perimeter")), "crop", "left")
    enough = F.count("stroke") >= F.least(F.lit(2), F.count("*"))
    height = F.when(F.col("stroke").isNotNull(), F.col("height"))
    medians = {"stroke": F.median("stroke"), "density": F.median("density"), "height": F.median(height)}
    return each.groupBy("doc_id", "heading").agg(*(F.when(enough, m).alias(n) for n, m in medians.items()))


def weight_status(heading: Column, body: Column) -> Column:
    """Status of both weights from structs (stroke, height): strokes are compared by their share of the letters' height."""
    ratio = (heading.stroke / body.stroke) * (body.height / heading.height)
    small = F.least(heading.height, body.height) < LEAST_HEIGHT
    return F.when(ratio.isNull() | small, "review").when(ratio >= HEAVIER, "match").when(ratio < LIGHTER, "mismatch").otherwise("review")


def tones(pixels: DataFrame, of_equals: str = "dark") -> DataFrame:
    """(crop, n, contrast, background_std): distance of the means of ink and background as a share of 255, and the deviation of the background."""
    both = pixels.join(ink(pixels, of_equals), ["crop", "x", "y"])
    level, on = F.col("level"), F.col("on")
    means = F.abs(F.avg(F.when(on, level)) - F.avg(F.when(~on, level))) / 255
    return both.groupBy("crop").agg(F.count("*").alias("n"), means.alias("contrast"), F.stddev_pop(F.when(~on, level)).alias("background_std"))


def word_tones(cores: DataFrame, strips: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, n_words, lower_contrast, upper_spread): quartiles over words(crop, doc_id) of the contrast within a word and of the spread in the strips above and below it (crop, side, ...)."""
    inner = percentiles(cores, 0.1, 0.9).select("crop", ((F.col("p90") - F.col("p10")) / 255).alias("contrast"))
    sides = strips.select(F.struct("crop", "side").alias("crop"), "x", "y", "level")
    outer = percentiles(sides, 0.1, 0.9).groupBy(F.col("crop.crop").alias("crop")).agg(F.max(F.col("p90") - F.col("p10")).alias("spread"))
    each = words.join(inner, "crop").join(outer, "crop").groupBy("doc_id").agg(F.count("*").cast("int").alias("n_words"), F.array_sort(F.collect_list("contrast")).alias("c"), F.array_sort(F.collect_list("spread")).alias("s"))
    return each.select("doc_id", "n_words", F.get("c", F.floor(F.col("n_words") / 4).cast("int")).alias("lower_contrast"), F.get("s", F.floor(3 * F.col("n_words") / 4).cast("int")).alias("upper_spread"))


def sampled_tones(page_pixels: DataFrame, words: DataFrame, image_height: int) -> DataFrame:
    """As ``word_tones``, from whole pages and words(doc_id, crop, text, left, top, width, height).

    Sampled are words that are high enough, have letters enough, and keep a margin of twice the pad to the image's
    borders; the strips stand one pad above and below the word, as high as a pad.
    """
    pad = F.greatest(F.lit(LEAST_PAD), F.bround(F.col("height") * PAD)).cast("int")
    first = F.get(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), F.lit(0))
    fit = words.withColumn("_pad", pad).where((F.col("height") >= SAMPLED_HEIGHT) & (F.length(first) >= SAMPLED_LETTERS) & (F.col("top") >= 2 * F.col("_pad")) & (F.col("top") + F.col("height") + 2 * F.col("_pad") <= image_height))
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("top") - 2 * F.col("_pad")).alias("at")), F.struct(F.lit(1).alias("side"), (F.col("top") + F.col("height") + F.col("_pad")).alias("at")))).alias("s")
    strips = fit.select("doc_id", "crop", "left", "width", F.col("_pad").alias("height"), side).select("doc_id", F.struct("crop", "s.side").alias("crop"), "left", F.col("s.at").alias("top"), "width", "height")
    cut = crops(page_pixels, strips).select(F.col("crop.crop").alias("crop"), F.col("crop.side").alias("side"), "x", "y", "level")
    return word_tones(crops(page_pixels, fit), cut, fit.select("crop", "doc_id"))


def contrast_status(contrast: Column, background_std: Column, n: Column, confidence: Column, n_words: Column, lower_contrast: Column, upper_spread: Column) -> Column:
    """A clear difference of tones with a calm background, or of words with calm strips, is a match; hardly any difference a mismatch."""
    sampled = n_words >= 8
    whole = (contrast >= 0.45) & (background_std <= 15) & (confidence >= 0.65) & sampled & (lower_contrast >= 0.45)
    local = sampled & (lower_contrast >= 0.55) & (upper_spread <= 12) & (confidence >= 0.85)
    return F.when((n < 500) | contrast.isNull(), "review").when(contrast < 0.15, "mismatch").when(F.coalesce(whole, F.lit(False)) | F.coalesce(local, F.lit(False)), "match").otherwise("review")
