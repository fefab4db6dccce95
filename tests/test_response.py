"""The whole response of a label, and the shape of one that comes from elsewhere."""

import json

from docproof.operators import comparison, extraction, refinement, warning
from docproof.plans.label_data import CLAUSES, HEADING
from docproof.sources import response
from pyspark.sql import functions as F
from test_refinement import APPLICATION, OWN

LINES = ["Stone & Hollow Distillery", "Straight Bourbon Whiskey", "40% ABV", "500 mL"]


def payloads(spark, evidence=None, calls=None):
    apps = spark.createDataFrame([OWN, (2, *OWN[1:])], APPLICATION)
    text = "\n".join([*LINES, f"{HEADING}: {' '.join(CLAUSES)}"])
    readings = spark.createDataFrame([(1, text, "plain", 5.0, 9.0, ["dark", "small", "dark"]), (2, None, "plain", 1.0, 2.0, None)], "doc_id int, text string, engine string, duration_ms double, total_ms double, warnings array<string>")
    lines = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(LINES)], "doc_id int, line_number int, text string")
    candidates = extraction.extract(lines)
    results = comparison.compare(apps, candidates)
    statements = warning.localised(readings)
    checks = warning.checks(statements, F.lit(500.0))
    return response.responses(apps, candidates, results, comparison.overall(results, warning.statuses(checks)), readings, statements, checks, evidence, calls)


def test_response(spark):
    evidence = spark.createDataFrame([(1, "class_type", "t", ["a"], "b", True, 7, 0.9, 3.0, 1, 2, 3, 4)], f"doc_id int, {refinement.EVIDENCE}")
    calls = spark.createDataFrame([(1, 2, 3.0, ["late", "dark"])], f"doc_id int, {refinement.CALLS}")
    rows = payloads(spark, evidence, calls).select("doc_id", "response", response.shape_errors(F.col("response")).alias("errors"), response.check_statuses(F.col("response")).alias("checks")).collect()
    got = {r.doc_id: json.loads(r.response) for r in rows}
    assert all(r.errors == [] for r in rows)
    one, two = got[1], got[2]
    assert one["warnings"] == ["dark", "small", "late"] and one["ocr_invocation_count"] == 3 and one["ocr_duration_ms"] == 8.0 and one["refinement_duration_ms"] == 3.0
    assert one["candidates"]["abv"] == [{"raw_value": "40% ABV", "normalized_value": "40.0", "source_line": "40% ABV", "line_number": 3}]
    assert one["results"]["net_contents"]["status"] == "match" and one["expected"]["net_contents"] == "500 mL"
    assert one["government_warning"]["localized_text"].startswith(HEADING) and one["government_warning"]["checks"]["wording"]["status"] == "match"
    assert one["ocr_refinements"][0]["crop"] == {"left": 1, "top": 2, "width": 3, "height": 4}
    assert two["raw_text"] == "" and two["warnings"] == [] and two["ocr_invocation_count"] == 1 and two["ocr_refinements"] == [] and "localized_text" not in two["government_warning"]
    assert next(r.checks[0] for r in rows if r.doc_id == 2) == "not_found"


def test_shape(spark):
    good = json.loads(payloads(spark).where("doc_id = 1").first().response)

    def spoilt(**changes):
        return json.dumps({**good, **changes})

    results = good["results"]
    cases = {
        json.dumps(good): [],
        spoilt(engine=None): ["engine is no text"],
        spoilt(ocr_duration_ms="8"): ["ocr_duration_ms is no number"],
        spoilt(ocr_duration_ms=8): [],
        spoilt(ocr_duration_ms=1e300): [],
        spoilt(government_warning=[]): ["government_warning is no object"],
        spoilt(results={**results, "abv": {"status": "fine", "explanation": "x"}}): ["abv has no known status"],
        spoilt(results={**results, "abv": {"status": "match", "explanation": 1}}): ["abv has no explanation"],
        spoilt(results={**results, "abv": {"status": 1, "explanation": "x"}, "more": 1}, extra=[1]): ["abv has no known status"],
        "[]": ["not a JSON object"], "": ["not a JSON object"], "{": ["not a JSON object"], "null": ["not a JSON object"], "7": ["not a JSON object"],
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "payload string").select("payload", response.shape_errors(F.col("payload")).alias("e")).collect()
    assert {r.payload: r.e for r in rows} == {**cases, None: ["not a JSON object"]}
    gone = {k: v for k, v in good.items() if k != "results"}
    only = spark.createDataFrame([(json.dumps(gone),)], "p string").select(response.shape_errors(F.col("p")).alias("e")).first().e
    assert only[0] == "results is no object" and len(only) == 15


def test_merged(spark):
    row = spark.createDataFrame([(["b", "a"], ["c", "a"], None)], "x array<string>, y array<string>, z array<string>").select(response.merged(F.col("x"), F.col("z"), F.col("y")).alias("m")).first()
    assert row.m == ["b", "a", "c"]
