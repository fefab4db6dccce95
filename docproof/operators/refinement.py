"""Reading parts of a label again: which regions, what a second reading says, and whether it replaces the first.

Only what stands on the label decides which region is read and whether a reading is accepted; the application is
compared again afterwards. Lines are those of ``layout.read_lines``: with boxes, sizes of the image and their words.
Candidates are those of ``extraction.extract``, whose ``place`` is their order within a field.

The three fields do not depend on each other, so all plans of all labels are made, read and judged at once. Plans,
readings and verdicts are stages: each is written before the next one is planned, and a reader is asked once.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docproof.functions import text as T
from docproof.operators import comparison, extraction, layout
from docproof.plans.stages import cut

#: Fields in the order of reading, regions of a label at most, a weak word, and the bounds of an accepted reading.
ORDER, MOST_PLANS, WEAK = ("net_contents", "brand_name", "class_type"), 3, 0.80
LEAST, SHORTEST, ALIKE, MEAN_GAIN, LEAST_GAIN = 0.55, 0.75, 0.65, 0.02, 0.10
#: A partner line's least width as shares of the anchor's and of the image's, its greatest distance as a share of the image's height, and what width counts against distance.
PARTNER_WIDTH, IMAGE_WIDTH, BAND, WIDTH_WEIGHT = 0.5, 0.12, 0.3, 0.05
#: A smaller line beside a large one is kept if it is so many times lower and so certain.
SMALLER, LEGIBLE = 2.5, 0.85
BOX = layout.BOX


class Reading(NamedTuple):
    """What a reader gives: outcomes(doc_id, field, text, duration_ms, error) of all plans, and the words of those without an error, as ``layout`` takes them, with doc_id and field."""

    outcomes: DataFrame
    words: DataFrame


EVIDENCE = "field string, trigger string, full_image_candidates array<string>, refined_text string, selected boolean, mode int, mean_confidence double, duration_ms double, left int, top int, width int, height int"
CALLS = "n_calls bigint, duration_ms double, warnings array<string>"


class Refinement(NamedTuple):
    candidates: DataFrame
    results: DataFrame
    evidence: DataFrame
    calls: DataFrame


@F.pandas_udf(DoubleType())
def _alike(before: pd.Series, after: pd.Series) -> pd.Series:
    """Ratio of matching blocks."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(before, after)], dtype="float64")


def source_lines(candidates: DataFrame, lines: DataFrame, behind: int = 2) -> DataFrame:
    """(doc_id, field, at, line): the lines of each candidate: its own, and those behind it whose text is within its value. Lines are met by number, not all lines of a label."""
    own = candidates.select("doc_id", "field", "line_number", T.text_key(F.col("raw_value")).alias("_value"), F.explode(F.sequence(F.lit(0), F.lit(behind))).alias("_step"))
    own = own.withColumn("at", F.col("line_number") + F.col("_step")).drop("line_number")
    met = own.join(lines.select("doc_id", F.col("line_number").alias("at"), F.struct("text", "words", "panel_id", *BOX).alias("line")), ["doc_id", "at"])
    return met.where((F.col("_step") == 0) | F.contains("_value", T.text_key(F.col("line.text")))).select("doc_id", "field", "at", "line")


def token_confidences(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, field, n, total, least): confidences of the words that a field's candidates consist of; unknown ones count as 0.

    A word counts if all of it is part of a value: marks beside a value neither help nor harm it.
    """
    words = source_lines(candidates, lines).select("doc_id", "field", F.explode("line.words").alias("w"))
    tokens = candidates.select("doc_id", "field", F.split(T.text_key(F.col("raw_value")), " ").alias("t")).groupBy("doc_id", "field").agg(F.flatten(F.collect_list("t")).alias("tokens"))
    keyed = words.select("doc_id", "field", T.text_key(F.col("w.text")).alias("key"), F.coalesce(F.col("w.confidence").cast("double"), F.lit(0.0)).alias("c"))
    part = (F.col("key") != "") & (F.size(F.array_except(F.split("key", " "), "tokens")) == 0)
    return keyed.join(tokens, ["doc_id", "field"]).where(part).groupBy("doc_id", "field").agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.min("c").alias("least"))


def _crop(box: Column, width: Column, height: Column, down: Column | float = 0.18, least_across: Column | None = None) -> Column:
    """A box with its margins, within the image."""
    across = F.greatest(F.lit(16), F.bround(box.width * 0.08), F.lit(0) if least_across is None else F.bround(least_across))
    return T.expanded(box, across, F.greatest(F.lit(12), F.bround(box.height * down)), width, height)


def _free(lines: DataFrame, excluded: DataFrame | None) -> DataFrame:
    boxed = lines.where("left is not null")
    if excluded is None:
        return boxed
    regions = excluded.select(F.col("doc_id").alias("_doc"), F.struct(*BOX).alias("_region"))
    return boxed.join(regions, (F.col("_doc") == F.col("doc_id")) & T.overlaps(F.struct(*BOX), F.col("_region")), "left_anti")


PLAN = ("doc_id", "field", "trigger", "box", "mode", "full_image_candidates", "source_lines", "text_height", "retained")


def volume_plans(results: DataFrame, candidates: DataFrame, free: DataFrame) -> DataFrame:
    """A region for each label whose volume was not found: the best partner of the line of its strength.

    A partner lies in the same panel, within a band of the image's height, is wide enough, and no candidate stands on
    it. Nearer is better, and so is wider up to the anchor's width.
    """
    missing = results.where((F.col("field") == "net_contents") & (F.col("status") == "not_found")).select("doc_id")
    first = candidates.where("field = 'abv' and place = 1").join(missing, "doc_id", "left_semi").select("doc_id", "line_number")
    anchor = free.join(first, ["doc_id", "line_number"]).select("doc_id", F.struct("panel_id", *BOX).alias("a"))
    occupied = candidates.where("field <> 'net_contents'").select("doc_id", "line_number").distinct()
    centre = lambda b: b.top + b.height / 2
    a, own = F.col("a"), F.struct("panel_id", *BOX)
    met = free.join(anchor, "doc_id").withColumn("distance", F.abs(centre(own) - centre(a)))
    fit = own.panel_id.eqNullSafe(a.panel_id) & (F.col("width") >= F.greatest(a.width * PARTNER_WIDTH, F.col("image_width") * IMAGE_WIDTH)) & (F.col("distance") <= F.col("image_height") * BAND)
    possible = met.where(fit & ~F.lower("text").contains("label with mandatory")).join(occupied, ["doc_id", "line_number"], "left_anti")
    score = F.col("distance") - F.least("width", a.width) * WIDTH_WEIGHT
    best = possible.groupBy("doc_id").agg(F.min_by(F.struct(*BOX, "image_width", "image_height"), F.struct(score, "line_number")).alias("b"))
    none = F.array().cast("array<string>")
    return best.select(
        "doc_id", F.lit("net_contents").alias("field"), F.lit("no volume was found near a prominent line").alias("trigger"), _crop(F.col("b"), F.col("b.image_width"), F.col("b.image_height")).alias("box"), F.lit(7).alias("mode"),
        none.alias("full_image_candidates"), F.array().cast("array<int>").alias("source_lines"), F.lit(None).cast("double").alias("text_height"), F.array().cast(RETAINED).alias("retained"),
    )


RETAINED = "array<struct<text:string,n:bigint,total:double,least:double>>"


def text_plans(results: DataFrame, candidates: DataFrame, lines: DataFrame, free: DataFrame) -> DataFrame:
    """A region for each brand or class that is under review or has a weak word: the lines of its first candidate, for a brand with those of the others that are shown beside it."""
    both = candidates.where(F.col("field").isin("brand_name", "class_type"))
    weak = token_confidences(both, lines).select("doc_id", "field", (F.col("least") < WEAK).alias("weak"))
    asked = results.select("doc_id", "field", "status").join(weak, ["doc_id", "field"], "left").where((F.col("status") == "review") | F.col("weak")).select("doc_id", "field")
    both = both.join(asked, ["doc_id", "field"], "left_semi")
    line = F.struct("line_number", "text", "panel_id", *BOX, "line_height", "mean_confidence", "image_width", "image_height", "words")
    at = free.select("doc_id", "line_number", line.alias("line"))
    own = both.where("place = 1").select("doc_id", "field", "line_number", F.col("norm_text").alias("value")).join(at.withColumnRenamed("line", "first"), ["doc_id", "line_number"])
    first = own.select("doc_id", "field", "value", "first")
    beside = both.where("place > 1 and field = 'brand_name'").select("doc_id", "field", "line_number").join(at, ["doc_id", "line_number"]).join(first, ["doc_id", "field"]).where(T.same_region(F.col("first"), F.col("line")))
    broken = first.where(T.text_key(F.col("first.text")) != F.col("value")).withColumn("line_number", F.explode(F.array(F.col("first.line_number") + 1, F.col("first.line_number") + 2)))
    behind = broken.join(at, ["doc_id", "line_number"]).where(F.col("line.panel_id").eqNullSafe(F.col("first.panel_id")) & F.contains("value", T.text_key(F.col("line.text"))))
    chosen = first.withColumn("line", F.col("first")).unionByName(beside.select("doc_id", "field", "value", "first", "line")).unionByName(behind.select("doc_id", "field", "value", "first", "line"))
    grouped = chosen.groupBy("doc_id", "field").agg(F.first("first").alias("first"), F.array_sort(F.collect_set("line")).alias("lines"))
    f, brand = F.col("first"), F.col("field") == "brand_name"
    smaller = F.filter("lines", lambda l: l.line_number != f.line_number)
    small = F.forall(smaller, lambda l: (l.top >= f.top + f.height) & (F.coalesce(l.line_height, F.lit(0.0)) * SMALLER < f.height) & F.coalesce(l.mean_confidence >= LEGIBLE, F.lit(False)))
    keeps = brand & (F.size(smaller) > 0) & small

    def told(l: Column) -> Column:
        known = F.filter(F.transform(l.words, lambda w: w.confidence.cast("double")), lambda c: c.isNotNull())
        return F.struct(l.text.alias("text"), F.size(known).cast("bigint").alias("n"), F.aggregate(known, F.lit(0.0), lambda s, c: s + c).alias("total"), F.array_min(known).alias("least"))

    kept = F.transform(F.array_sort(F.transform(smaller, lambda l: F.struct(l.top.alias("y"), l.line_number.alias("k"), l.alias("line")))), lambda x: told(x.line)).cast(RETAINED)
    heights = F.flatten(F.transform("lines", lambda l: F.transform(F.filter(l.words, lambda w: w.left.isNotNull()), lambda w: w.height.cast("double"))))
    box = layout.union_box(F.transform("lines", lambda l: F.struct(*(l[c].alias(c) for c in BOX))))
    crop = _crop(box, f.image_width, f.image_height, F.when(F.col("field") == "class_type", 0.35).otherwise(0.18), F.when(keeps, f.height * 0.5).otherwise(0.0))
    said = both.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_value"))), lambda c: c.raw_value).alias("full_image_candidates"))
    return grouped.join(said, ["doc_id", "field"]).select(
        "doc_id", "field", F.concat(F.lit("uncertain text or a weak word in "), "field").alias("trigger"), crop.alias("box"), F.when(brand | (F.size("lines") > 1), 6).otherwise(7).alias("mode"), "full_image_candidates",
        F.transform("lines", lambda l: l.line_number.cast("int")).alias("source_lines"), F.when(~keeps, _middle(heights)).alias("text_height"), F.when(keeps, kept).otherwise(F.array().cast(RETAINED)).alias("retained"),
    )


def _middle(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def plans(results: DataFrame, candidates: DataFrame, lines: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Regions to read again: doc_id, field, trigger, left, top, width, height, mode (6 a block of lines, 7 one line), full_image_candidates, source_lines, text_height and retained lines.

    At most ``MOST_PLANS`` of a label, in the order of ``ORDER``; then those that meet a region of
    excluded(doc_id, left, top, width, height) go, whose lines take no part at all.
    """
    free = _free(lines, excluded)
    every = volume_plans(results, candidates, free).unionByName(text_plans(results, candidates, lines, free))
    #: One plan for each of the three fields, so no label has more than the bound.
    boxed = every.select(*(c for c in PLAN if c != "box"), *(F.col(f"box.{c}").cast("int").alias(c) for c in BOX))
    if excluded is None:
        return boxed
    e = excluded.select(F.col("doc_id").alias("_doc"), *(F.col(c).alias(f"_{c}") for c in BOX))
    meets = (F.col("left") < F.col("_left") + F.col("_width")) & (F.col("_left") < F.col("left") + F.col("width")) & (F.col("top") < F.col("_top") + F.col("_height")) & (F.col("_top") < F.col("top") + F.col("height"))
    return boxed.join(e, (F.col("doc_id") == F.col("_doc")) & meets, "left_anti")


def stronger(before_text: Column, before: Column, after_text: Column, after: Column, n_after: Column) -> Column:
    """Whether a second reading replaces the first; before and after are structs (n, total, least) of confidences.

    It must be the only candidate and certain word by word. Where nothing was read before, that is enough; else it
    must be about as long as the first, resemble it, and be surer on the whole or in its least sure word.
    """
    single = (n_after == 1) & F.coalesce(after.least >= LEAST, F.lit(False))
    resembles = (F.length(after_text) >= F.length(before_text) * SHORTEST) & (_alike(before_text, after_text) >= ALIKE)
    surer = (after.total / after.n >= before.total / before.n + MEAN_GAIN) | (after.least >= before.least + LEAST_GAIN)
    return single & (before_text.isNull() | F.coalesce(resembles & surer, F.lit(False)))


def judged(planned: DataFrame, candidates: DataFrame, lines: DataFrame, reading: Reading) -> DataFrame:
    """One row for each plan: its columns, text, duration_ms, error, mean_confidence, ``after`` (the candidate of the reading) and selected."""
    key = F.struct("doc_id", "field")
    read_lines = cut(layout.read_lines(reading.words.withColumn("doc_id", key).drop("field")))
    found = extraction.extract(read_lines).where(F.col("field") == F.col("doc_id.field"))
    value = F.struct("raw_value", "norm_text", "norm_num", "source_line", "line_number")
    own = found.groupBy("doc_id").agg(F.count("*").alias("n_after"), F.min_by(value, "place").alias("after"))
    known = F.filter(F.transform("words", lambda w: w.confidence.cast("double")), lambda c: c.isNotNull())
    seen = read_lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), (F.sum(F.aggregate(known, F.lit(0.0), lambda s, c: s + c)) / F.nullif(F.sum(F.size(known)), F.lit(0))).alias("mean_confidence"))
    #: A smaller line that is legible already may be missing in a second reading of a block: it is kept beside the one line read.
    text, texts = F.col("text"), F.col("retained.text")
    rows = planned.join(reading.outcomes, ["doc_id", "field"]).join(_by_plan(own), ["doc_id", "field"], "left").join(_by_plan(seen), ["doc_id", "field"], "left")
    keys = T.key_of_folded
    folds = T.all_folded(F.concat(F.array(text, F.array_join(F.concat(F.array(text), texts), " ")), texts))
    rows = rows.withColumn("_folds", folds)
    read_key = keys(F.col("_folds")[0])
    held = F.exists(F.slice("_folds", 3, F.greatest(F.size("_folds") - 2, F.lit(0))), lambda t: F.contains(read_key, keys(t)))
    adds = (F.size("retained") > 0) & (F.col("n_lines") == 1) & text.rlike(r"[\p{L}\p{N}]") & ~held
    whole = F.array_join(F.concat(F.array(text), texts), " ")
    joined = F.struct(whole.alias("raw_value"), keys(F.col("_folds")[1]).alias("norm_text"), F.lit(None).cast("double").alias("norm_num"), F.concat(F.lit("Read again: "), text, F.lit("\nKept: "), F.array_join(texts, " / ")).alias("source_line"), F.lit(1).alias("line_number"))
    rows = rows.withColumn("_adds", F.coalesce(adds, F.lit(False)))
    rows = cut(rows.withColumn("after", F.when(F.col("_adds"), joined).otherwise(F.col("after"))).withColumn("n_after", F.when(F.col("_adds"), 1).otherwise(F.coalesce("n_after", F.lit(0)))).drop("_folds", "_adds", "n_lines"))
    after = rows.where("n_after = 1").select(key.alias("doc_id"), "field", F.col("after.raw_value").alias("raw_value"), F.col("after.line_number").alias("line_number"))
    sure = _by_plan(token_confidences(after, read_lines).drop("field")).select("doc_id", "field", F.struct("n", "total", "least").alias("_after"))
    first = candidates.join(planned.select("doc_id", "field", "source_lines"), ["doc_id", "field"]).where(F.array_contains("source_lines", F.col("line_number"))).drop("source_lines")
    before = first.groupBy("doc_id", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_value"))), lambda c: c.raw_value), " ").alias("_text"))
    was = token_confidences(first, lines).select("doc_id", "field", F.struct("n", "total", "least").alias("_before"))
    for more in (sure, before, was):
        rows = rows.join(more, ["doc_id", "field"], "left")
    extra = lambda what, start, op: F.aggregate("retained", start, lambda s, r: op(s, r[what]))
    a = F.struct(
        (F.coalesce(F.col("_after.n"), F.lit(0)) + extra("n", F.lit(0).cast("bigint"), lambda s, v: s + v)).alias("n"), (F.coalesce(F.col("_after.total"), F.lit(0.0)) + extra("total", F.lit(0.0), lambda s, v: s + v)).alias("total"),
        F.least(F.col("_after.least"), F.array_min(F.transform("retained", lambda r: r.least))).alias("least"),
    )
    strong = stronger(F.when(F.col("_text").isNotNull(), T.text_key(F.col("_text"))), F.col("_before"), T.text_key(F.col("after.raw_value")), a, F.col("n_after"))
    return rows.withColumn("selected", F.col("error").isNull() & F.coalesce(strong, F.lit(False))).drop("_after", "_before", "_text", "n_after")


def _by_plan(rows: DataFrame) -> DataFrame:
    """Rows of readings, whose key is a struct, with the label's id and field again."""
    return rows.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.field").alias("field"), *(c for c in rows.columns if c != "doc_id"))


def refine(applications: DataFrame, candidates: DataFrame, results: DataFrame, lines: DataFrame, read: Callable[[DataFrame], Reading] | None, excluded: DataFrame | None = None) -> Refinement:
    """Plans, reads, judges, and compares again what was replaced.

    ``read`` takes the plans. evidence has one row for each reading that succeeded; calls(doc_id, n_calls, duration_ms,
    warnings) counts failed ones too, which keep what the label had. Without a reader of regions nothing is planned.
    """
    if read is None:
        nothing = candidates.sparkSession.createDataFrame
        key = f"doc_id {candidates.schema['doc_id'].dataType.simpleString()}"
        return Refinement(candidates, results, nothing([], f"{key}, {EVIDENCE}"), nothing([], f"{key}, {CALLS}"))
    lines, candidates, results = cut(lines), cut(candidates), cut(results)
    planned = cut(plans(results, candidates, lines, excluded))
    rows = cut(judged(planned, candidates, lines, read(planned)))
    chosen = rows.where("selected").select("doc_id", "field", "after.*").withColumn("place", F.lit(1))
    kept = candidates.join(chosen.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    now = kept.unionByName(chosen.select(*kept.columns))
    again = comparison.compare(applications.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"), chosen)
    same = results.join(chosen.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    renewed = same.unionByName(again.join(chosen.select("doc_id", "field"), ["doc_id", "field"], "left_semi"))
    evidence = rows.where("error is null").select("doc_id", "field", "trigger", "full_image_candidates", F.col("text").alias("refined_text"), "selected", "mode", "mean_confidence", "duration_ms", *BOX)
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("Reading "), "field", F.lit(" again failed; what the whole image gave was kept.")))
    calls = rows.groupBy("doc_id").agg(F.count("*").alias("n_calls"), F.sum(F.when(F.col("error").isNull(), F.col("duration_ms")).otherwise(0.0)).alias("duration_ms"), F.array_sort(F.collect_list(failed)).alias("warnings"))
    return Refinement(now, renewed, evidence, calls)


def from_words(words: DataFrame) -> Callable[[DataFrame], Reading]:
    """A reader over a table of words of finer readings: a region says the words whose centres lie in it; one without words is an error."""

    def read(planned: DataFrame) -> Reading:
        region = planned.select("doc_id", "field", *(F.col(c).alias(f"_{c}") for c in BOX))
        x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
        inside = x.between(F.col("_left"), F.col("_left") + F.col("_width")) & y.between(F.col("_top"), F.col("_top") + F.col("_height"))
        held = words.join(region, "doc_id").where(inside).drop(*(f"_{c}" for c in BOX))
        said = layout.spoken(held, "doc_id", "field")
        outcomes = planned.select("doc_id", "field").join(said, ["doc_id", "field"], "left")
        return Reading(outcomes.select("doc_id", "field", "text", F.lit(0.0).alias("duration_ms"), F.when(F.col("text").isNull(), "processing").alias("error")), held)

    return read
