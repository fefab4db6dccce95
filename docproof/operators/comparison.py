"""Expected values against candidates: one status for each field with its evidence, and summaries over them.

Similarity only tells review from mismatch and never makes a match; several distinct values force a review; no
candidate is not_found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docproof.functions import text as T

#: Least similarity of a review, by field.
THRESHOLDS = {"brand_name": 0.80, "class_type": 0.72, "producer_name": 0.80, "producer_address": 0.72, "country_origin": 0.80}
SEVERAL = ("brand_name", "producer_name", "producer_address", "country_origin", "abv", "net_contents")
FIELDS = ["brand_name", "class_type", "abv", "net_contents", "producer_name", "producer_address", "country_origin"]
#: Field statuses from bad to good.
SEVERITY = {"mismatch": 4, "review": 3, "not_found": 2, "match": 1, "not_applicable": 0}


def expected_long(applications: DataFrame) -> DataFrame:
    """(doc_id, field, expected_raw, expected_text, expected_num, applies) from one row for each application, in one pass."""
    known = [f for f in FIELDS if f in applications.columns]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("raw")) for f in known))).alias("e")
    imported = F.col("imported_product") if "imported_product" in applications.columns else F.lit(True)
    rows = applications.select("doc_id", imported.alias("imported"), each).select("doc_id", "imported", "e.field", "e.raw")
    field, raw, key = F.col("field"), F.col("raw"), T.text_key(F.col("raw"))
    number = F.when(field == "abv", raw.try_cast("double")).when(field == "net_contents", T.volume(raw))
    text = F.when(field.isin("abv", "net_contents"), None).when(field == "producer_address", T.state_codes(key)).when(field == "country_origin", T.country_of_key(key)).otherwise(key)
    return rows.select("doc_id", "field", raw.alias("expected_raw"), text.alias("expected_text"), number.alias("expected_num"), ((field != "country_origin") | F.col("imported")).alias("applies"))


def compare(applications: DataFrame, candidates: DataFrame) -> DataFrame:
    """Field results: doc_id, field, status, extracted_raw, similarity_score, n_values, found_values (sorted), evidence (in line order)."""
    joined = expected_long(applications).join(candidates, ["doc_id", "field"], "left")
    exact = F.col("norm_text").eqNullSafe(F.col("expected_text")) & F.col("norm_num").eqNullSafe(F.col("expected_num")) & F.col("line_number").isNotNull()
    scored = joined.withColumn("exact", exact).withColumn("score", F.when(~exact, T.similarity("expected_text", "norm_text")))
    best = F.struct(F.col("exact").cast("int"), F.coalesce("score", F.lit(0.0)), -F.col("line_number"))
    value = F.coalesce("norm_text", T.number_label(F.col("norm_num")))
    grouped = scored.groupBy("doc_id", "field", "expected_raw", "expected_text", "applies").agg(
        F.count("line_number").alias("n"),
        F.bool_or("exact").alias("any_exact"),
        F.array_sort(F.collect_set(value)).alias("found_values"),
        F.max_by("raw_value", best).alias("extracted_raw"),
        F.max_by("norm_text", best).alias("extracted_text"),
        F.max("score").alias("score"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "source_line"))), lambda s: s.source_line)).alias("evidence"),
    )
    several = F.col("field").isin(*SEVERAL) & (F.size("found_values") > 1)
    threshold = F.element_at(F.create_map(*(F.lit(x) for pair in THRESHOLDS.items() for x in pair)), F.col("field"))
    expected_words, found_words = F.split("expected_text", " "), F.split("extracted_text", " ")
    other_state = T.address_state(F.col("expected_text")) != T.address_state(F.col("extracted_text"))
    part_of = (F.size(F.array_except(found_words, expected_words)) == 0) & (F.size(F.array_except(expected_words, found_words)) > 0)
    status = (
        F.when(~F.col("applies"), "not_applicable")
        .when(F.col("n") == 0, "not_found")
        .when(several, "review")
        .when(F.col("any_exact"), "match")
        .when(F.col("field").isin("abv", "net_contents"), "mismatch")
        .when((F.col("field") == "producer_address") & F.coalesce(other_state, F.lit(False)), "mismatch")
        .when((F.col("field") == "producer_address") & F.coalesce(part_of, F.lit(False)), "review")
        .when(F.col("score") >= F.coalesce(threshold, F.lit(1.0)), "review")
        .otherwise("mismatch")
    )
    return grouped.select("doc_id", "field", status.alias("status"), "expected_raw", "extracted_raw", F.round("score", 3).alias("similarity_score"), F.size("found_values").alias("n_values"), "found_values", "evidence")


#: Sentences of the summary.
SUMMARY = {
    ("mismatch", False): "One or more application fields do not match the label.",
    ("review", False): "One or more fields require manual review.",
    ("match", False): "All checked application fields match the label.",
    ("mismatch", True): "One or more detected fields differ from the application or prescribed warning.",
    ("review", True): "One or more label checks require manual review.",
    ("match", True): "All checked application fields match the label.",
    ("manual", True): "All checks completed by this tool matched.",
}


def overall(results: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """doc_id, overall_status, issues and summary: the worst status of all fields (not_found counts as review), and what is not a match.

    warnings(doc_id, automated_status, manual_confirmation_required) count as one more field; an open manual confirmation alone only adds a sentence.
    """
    rank = F.when(F.col("status") == "mismatch", 3).when(F.col("status").isin("review", "not_found"), 2).otherwise(1)
    order = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    issue = F.when(~F.col("status").isin("match", "not_applicable"), F.struct(order.alias("o"), F.concat_ws(": ", F.replace("field", F.lit("_"), F.lit(" ")), "status").alias("t")))
    grouped = results.groupBy("doc_id").agg(F.max(rank).alias("worst"), F.array_sort(F.collect_list(issue)).alias("issues")).withColumn("issues", F.transform("issues", lambda i: i.t))
    manual = F.lit(False)
    if warnings is not None:
        grouped = grouped.join(warnings.select("doc_id", "automated_status", "manual_confirmation_required"), "doc_id", "left")
        own, manual = F.coalesce("automated_status", F.lit("not_found")), F.coalesce("manual_confirmation_required", F.lit(False))
        grouped = grouped.withColumn("worst", F.greatest("worst", F.when(own == "mismatch", 3).when(own != "match", 2).otherwise(1)))
        grouped = grouped.withColumn("issues", F.when(own == "match", F.col("issues")).otherwise(F.array_append("issues", F.concat(F.lit("government warning: "), own))))
    status = F.element_at(F.array(F.lit("match"), F.lit("review"), F.lit("mismatch")), F.col("worst"))
    said = F.create_map(*(F.lit(x) for (k, with_warning), v in SUMMARY.items() if with_warning == (warnings is not None) for x in (k, v)))
    summary = F.element_at(said, F.when(manual & (F.col("worst") == 1), "manual").otherwise(status))
    listed = F.array_join("issues", "; ")
    if warnings is not None:
        listed = F.when(F.size("issues") == 0, SUMMARY["manual", True]).otherwise(listed)
        listed = F.concat(listed, F.when(manual, " Manual physical confirmation required.").otherwise(""))
    return grouped.select("doc_id", status.alias("overall_status"), listed.alias("issues"), summary.alias("summary"))


def displayed_status(overall: DataFrame) -> DataFrame:
    """Adds manual_note: that a physical confirmation is open, only where everything else matches."""
    note = F.when(F.col("overall_status") == "match", F.when(F.col("issues").endswith("Manual physical confirmation required."), "Manual physical confirmation required."))
    return overall.withColumn("manual_note", note)


def status_counts(results: DataFrame) -> DataFrame:
    """For each field one row with a count of every status, zeros included."""
    return results.groupBy("field").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in SEVERITY))


def confusion(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per check of expected(doc_id, field, expected_status): exact, false matches, false mismatches, missed matches and accuracy."""
    joined = expected.join(actual.select("doc_id", "field", "status"), ["doc_id", "field"], "left")
    e, a = F.col("expected_status"), F.col("status")
    return joined.groupBy("field").agg(
        F.count("*").alias("n"),
        F.count_if(e == a).alias("n_exact"),
        F.count_if((a == "match") & (e != "match")).alias("n_false_match"),
        F.count_if((a == "mismatch") & (e != "mismatch")).alias("n_false_mismatch"),
        F.count_if((e == "match") & ~a.eqNullSafe(F.lit("match"))).alias("n_missed_match"),
        F.round(F.count_if(e == a) / F.count("*"), 4).alias("accuracy"),
    )


def latency(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median (mean of the middle two), nearest-rank 90th percentile and maximum."""
    return times.groupBy(*by).agg(F.percentile(value, 0.5).alias("median_ms"), F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90_ms"), F.max(value).alias("max_ms"), F.count(value).alias("n"))


def grouped_status_counts(checks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of every status by group and check, and by group over the pseudo-check "overall" (the worst of a document's checks); checks(*by, doc_id, check, status)."""
    order = F.array(*(F.lit(s) for s in sorted(SEVERITY, key=SEVERITY.get, reverse=True)))
    worst = F.element_at(order, F.min(F.array_position(order, F.col("status"))).cast("int"))
    whole = checks.groupBy(*by, "doc_id").agg(worst.alias("status")).select(*by, "doc_id", F.lit("overall").alias("check"), "status")
    counted = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in SEVERITY]
    return checks.select(*by, "doc_id", "check", "status").unionByName(whole).groupBy(*by, "check").agg(*counted)


def expected_checks(applications: DataFrame) -> DataFrame:
    """(doc_id, field): what an application lets one expect: every field it fills; the origin only if imported."""
    rows = expected_long(applications)
    return rows.where((F.coalesce(F.trim("expected_raw"), F.lit("")) != "") & F.col("applies")).select("doc_id", "field")


def label_report(applications: DataFrame, results: DataFrame) -> DataFrame:
    """Per field: counts of every status, expected checks that do not match, and matches whose values do not agree when normalised."""
    expected = expected_checks(applications).withColumn("expected", F.lit(True))
    agree = T.text_key(F.col("expected_raw")) == T.text_key(F.col("extracted_raw"))
    joined = results.join(expected, ["doc_id", "field"], "left")
    text = ~F.col("field").isin("abv", "net_contents", "country_origin", "producer_address")
    return joined.groupBy("field").agg(
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in SEVERITY),
        F.count_if(F.col("expected") & (F.col("status") != "match")).alias("n_missed_expected"),
        F.count_if((F.col("status") == "match") & text & ~F.coalesce(agree, F.lit(False))).alias("n_false_confident"),
    )


def missing_evidence(results: DataFrame) -> DataFrame:
    """One row: documents, and those with a field that was not found."""
    each = results.groupBy("doc_id").agg(F.bool_or(F.col("status") == "not_found").alias("missing"))
    return each.agg(F.count("*").alias("n_documents"), F.count_if("missing").alias("n_missing_evidence"))


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Per document the checks whose status is not the expected one, as text in order of the checks."""
    joined = expected.join(actual.select("doc_id", "field", "status"), ["doc_id", "field"]).where(~F.col("status").eqNullSafe(F.col("expected_status")))
    said = F.concat(F.col("field"), F.lit(": "), F.col("expected_status"), F.lit(" -> "), F.col("status"))
    return joined.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(said)), "; ").alias("differences"), F.count("*").alias("n_differences"))


def progress(items: DataFrame, by: list[str]) -> DataFrame:
    """Per batch of items(*by, status): total, completed, processing, failed, and remaining, which is never below 0."""
    done = F.count_if(F.col("status").isin("match", "review", "mismatch", "error", "invalid"))
    total, processing = F.count("*"), F.count_if(F.col("status") == "processing")
    return items.groupBy(*by).agg(total.alias("n_total"), done.alias("n_completed"), processing.alias("n_processing"), F.count_if(F.col("status") == "error").alias("n_failed"), F.greatest(total - done - processing, F.lit(0)).alias("n_remaining"))
