"""The evaluation report and its gates."""

import json

import pytest

from docproof.operators import evaluation


def test_report_and_gates(spark, tmp_path):
    expected = spark.createDataFrame([(1, "abv", "match"), (1, "brand", "match"), (2, "abv", "mismatch"), (2, "brand", "match"), (3, "abv", "match")], "doc_id int, field string, expected_status string")
    actual = spark.createDataFrame([(1, "abv", "match"), (1, "brand", "review"), (2, "abv", "match"), (2, "brand", "mismatch"), (2, "other", "match")], "doc_id int, field string, status string")
    runs = spark.createDataFrame([(1, "read", 10.0, 3, None), (1, "judge", 2.0, 0, None), (2, "read", 30.0, 1, None), (3, "read", None, 1, "timeout")], "doc_id int, stage string, ms double, n_calls int, error string")
    report = evaluation.evaluate(expected, actual, runs, str(tmp_path / "cases"))
    assert {k: report[k] for k in ("n_expectations", "n_exact", "n_false_match", "n_false_mismatch", "n_missed_match", "n_review", "n_not_found", "accuracy")} == {
        "n_expectations": 5, "n_exact": 1, "n_false_match": 1, "n_false_mismatch": 1, "n_missed_match": 3, "n_review": 1, "n_not_found": 0, "accuracy": 0.2,
    }
    assert (report["n_cases"], report["n_failures"], report["n_calls"], report["median_calls"], report["most_calls"]) == (3, 1, 5, 1.0, 3)
    assert report["latency_ms"] == {"judge": {"median": 2.0, "p90": 2.0, "slowest": 2.0}, "read": {"median": 20.0, "p90": 30.0, "slowest": 30.0}}
    assert report["per_check"]["brand"]["review"] == 1 and json.loads(evaluation.as_json(report)) == report and "false matches 1" in evaluation.summary(report)
    with pytest.raises(evaluation.GateError, match="n_failures is 1.*n_false_match is 1") as raised:
        evaluation.check(report)
    assert len(raised.value.missed) == 2
    evaluation.check(report, (("n_failures", "<=", 1), ("accuracy", ">=", 0.2)))
    with pytest.raises(evaluation.GateError):
        evaluation.check(report, (("n_unknown", "<=", 1),))
    assert {r.doc_id: r.differences for r in evaluation.differences(str(tmp_path / "cases"), spark).collect()} == {1: "brand: match -> review", 2: "abv: mismatch -> match; brand: match -> mismatch"}


def test_empty_report(spark, tmp_path):
    none = lambda schema: spark.createDataFrame([], schema)
    report = evaluation.evaluate(none("doc_id int, field string, expected_status string"), none("doc_id int, field string, status string"), none("doc_id int, stage string, ms double, n_calls int, error string"), str(tmp_path / "cases"))
    assert (report["accuracy"], report["n_cases"], report["n_calls"], report["median_calls"], report["latency_ms"]) == (0, 0, 0, 0.0, {})
    evaluation.check(report)
