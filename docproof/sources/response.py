"""The response of a verification: one JSON object for each label, and what is wrong with one that comes from elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators.comparison import FIELDS, SEVERITY
from docproof.operators.warning import CHECKS

#: What a response must have, by the type of its values.
TEXTS, NUMBERS, OBJECTS = ("overall_summary", "raw_text", "engine"), ("total_verification_duration_ms", "ocr_duration_ms"), ("government_warning", "results")
#: What a status says of a field.
SAYS = {
    "match": "The label states what the application states.", "review": "The label is close to the application or says several things; a person must decide.", "mismatch": "The label states something else than the application.",
    "not_found": "The label states nothing that could be compared.", "not_applicable": "Nothing is asked for here.",
}


def explanation(status: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SAYS.items() for x in pair)), status)


def merged(*warnings: Column) -> Column:
    """Lists of warnings as one, each warning where it comes first; a null list is an empty one."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*(F.coalesce(w, none) for w in warnings)))


def _by_name(rows: DataFrame, name: str, value: Column, alias: str) -> DataFrame:
    """A struct for each document with the value of each name, null where there is none."""
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias(alias))


def responses(applications: DataFrame, candidates: DataFrame, results: DataFrame, overall: DataFrame, readings: DataFrame, statements: DataFrame, checks: DataFrame, evidence: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """(doc_id, response) of every reading.

    readings(doc_id, text, engine, duration_ms, total_ms, warnings) are those of whole images, statements the located
    warnings (found, statement, source_lines, and box and mean_confidence where there are any), checks their checks;
    evidence and calls are what ``refinement.refine`` gives. A label without candidates, statement or second readings
    has empty lists there. What belongs to a label is brought together by its id, table by table, before the join.
    """
    d = "doc_id"
    value = F.struct("place", "raw_value", F.coalesce("norm_text", F.col("norm_num").cast("string")).alias("normalized_value"), "source_line", "line_number")
    of = lambda f: F.transform(F.array_sort(F.filter("all", lambda c: c.field == f)), lambda c: c.v.dropFields("place")).alias(f)
    listed = candidates.groupBy(d).agg(F.collect_list(F.struct("field", value.alias("v"))).alias("all")).select(d, F.struct(*map(of, FIELDS)).alias("candidates"))
    field = F.struct("status", explanation(F.col("status")).alias("explanation"), "expected_raw", "extracted_raw", "similarity_score", "evidence")
    fields = _by_name(results, "field", field, "results")
    check = F.struct("status", F.coalesce("note", explanation(F.col("status"))).alias("explanation"))
    checked = _by_name(checks, "check", check, "checks")
    whole = statements.select(d, F.struct(F.when(F.col("found"), F.col("statement")).alias("localized_text"), "source_lines", *(F.col(c) for c in ("box", "mean_confidence") if c in statements.columns)).alias("at"))
    given = applications.select(d, F.struct(*(F.col(c) for c in applications.columns if c != d)).alias("expected"))
    rows = readings.join(given, d, "left")
    for more in (listed, fields, checked, whole, overall.select(d, F.col("summary").alias("overall_summary"))):
        rows = rows.join(more, d, "left")
    if evidence is not None:
        read = F.struct("field", "trigger", "full_image_candidates", "refined_text", "selected", "mode", "mean_confidence", "duration_ms", F.struct("left", "top", "width", "height").alias("crop"))
        rows = rows.join(evidence.groupBy(d).agg(F.array_sort(F.collect_list(read)).alias("ocr_refinements")), d, "left")
    again = F.coalesce("_ms", F.lit(0.0))
    if calls is not None:
        rows = rows.join(calls.select(d, F.col("n_calls").alias("_n"), F.col("duration_ms").alias("_ms"), F.col("warnings").alias("_warnings")), d, "left")
    else:
        rows = rows.withColumns({"_n": F.lit(0), "_ms": F.lit(0.0), "_warnings": F.lit(None).cast("array<string>")})
    refined = [F.coalesce("ocr_refinements", F.array()).alias("ocr_refinements")] if evidence is not None else []
    response = F.struct(
        "expected", "candidates", "results", F.struct("at.*", "checks").alias("government_warning"), "overall_summary", F.coalesce("text", F.lit("")).alias("raw_text"), "engine", F.col("total_ms").alias("total_verification_duration_ms"),
        (F.col("duration_ms") + again).alias("ocr_duration_ms"), again.alias("refinement_duration_ms"), (1 + F.coalesce("_n", F.lit(0))).alias("ocr_invocation_count"), *refined, merged(F.col("warnings"), F.col("_warnings")).alias("warnings"),
    )
    return rows.select(d, F.to_json(response).alias("response"))


def parsed_once(payload: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a payload's parsed value, null for text that is no JSON, parsed once."""
    return T.once(F.try_parse_json(payload), of)


def shape_errors(payload: Column) -> Column:
    """What is wrong with a response, an array in the order of the rules; empty for a right one.

    Text that is no JSON object, or null, has one error. A null value is a missing one; numbers in quotes are no
    numbers; values that no rule names may be anything.
    """
    return parsed_once(payload, shape_errors_of)


def shape_errors_of(parsed: Column) -> Column:
    """As ``shape_errors``, of a parsed payload."""

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("VOID"))

    def is_object(path: str) -> Column:
        return F.try_variant_get(parsed, path, "map<string,variant>").isNotNull()

    number = lambda path: kind(path).rlike(r"\A(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
    wrong = [F.when(kind(f"$.{c}") != "STRING", F.lit(f"{c} is no text")) for c in TEXTS]
    wrong += [F.when(~number(f"$.{c}"), F.lit(f"{c} is no number")) for c in NUMBERS]
    wrong += [F.when(~is_object(f"$.{c}"), F.lit(f"{c} is no object")) for c in OBJECTS]
    for f in FIELDS:
        status = F.when(kind(f"$.results.{f}.status") == "STRING", F.try_variant_get(parsed, f"$.results.{f}.status", "string"))
        wrong.append(F.when(~F.coalesce(status.isin(*SEVERITY), F.lit(False)), F.lit(f"{f} has no known status")))
        wrong.append(F.when(kind(f"$.results.{f}.explanation") != "STRING", F.lit(f"{f} has no explanation")))
    none = F.array(F.lit("not a JSON object"))
    return F.when(is_object("$"), F.filter(F.array(*wrong), lambda w: w.isNotNull())).otherwise(none)


def check_statuses(payload: Column) -> Column:
    """The statuses of the warning's checks in a response, in their order; null where one is missing."""
    return parsed_once(payload, check_statuses_of)


def check_statuses_of(parsed: Column) -> Column:
    """As ``check_statuses``, of a parsed payload."""
    return F.array(*(F.try_variant_get(parsed, f"$.government_warning.checks.{c}.status", "string") for c in CHECKS))
