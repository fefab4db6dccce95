"""Evaluation of a run against expected statuses: a report, and gates that it must pass.

Cases may be many: their rows are written once, and the totals are observed in the pass that writes them. What comes to
the driver are totals, and one row for each check and each stage.
"""

from __future__ import annotations

import json
import operator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docproof.operators import comparison

#: A gate: the total, how it must stand to the bound, and the bound.
Gate = tuple[str, str, float]
#: Fixed value: a report without failures and without matches that should be none.
GATES: tuple[Gate, ...] = (("n_failures", "<=", 0), ("n_false_match", "<=", 0))
_HOLDS = {"<=": operator.le, ">=": operator.ge, "==": operator.eq}


class GateError(AssertionError):
    """A report that misses a gate; ``missed`` lists (total, its value, relation, bound)."""

    def __init__(self, missed: list[tuple]):
        super().__init__("; ".join(f"{name} is {value}, not {how} {bound}" for name, value, how, bound in missed))
        self.missed = missed


def judged(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of expected(doc_id, field, expected_status) with the actual status, null where there is none, and what it means."""
    met = expected.join(actual.select("doc_id", "field", "status"), ["doc_id", "field"], "left")
    e, a = F.col("expected_status"), F.col("status")
    verdict = F.when(a.isNull(), "missing").when(a == e, "exact").when(a == "match", "false_match").when(a == "mismatch", "false_mismatch").when(e == "match", "missed_match").otherwise("other")
    return met.withColumn("verdict", verdict)


def evaluate(expected: DataFrame, actual: DataFrame, runs: DataFrame, path: str) -> dict:
    """The report of a run; the judged rows are written to ``path``.

    runs(doc_id, stage, ms, n_calls, error) has a row for each stage of each case; a case with an error counts as a
    failure, whatever else it has. A false mismatch of an expected match is a missed match too.
    """
    totals = Observation()
    e, a = F.col("expected_status"), F.col("status")
    counted = {
        "n_expectations": F.count(F.lit(1)), "n_exact": F.count_if(a.eqNullSafe(e)), "n_false_match": F.count_if(F.col("verdict") == "false_match"), "n_false_mismatch": F.count_if(F.col("verdict") == "false_mismatch"),
        "n_missed_match": F.count_if((e == "match") & ~a.eqNullSafe(F.lit("match"))), "n_review": F.count_if(a == "review"), "n_not_found": F.count_if(a == "not_found"),
    }
    judged(expected, actual).observe(totals, *(c.alias(n) for n, c in counted.items())).write.mode("overwrite").parquet(path)
    report = dict(totals.get)
    report["accuracy"] = round(report["n_exact"] / report["n_expectations"], 4) if report["n_expectations"] else 0
    cases = runs.groupBy("doc_id").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("n_calls"), F.lit(0)).alias("n_calls"))
    calls = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("failed").alias("n_failures"), F.coalesce(F.sum("n_calls"), F.lit(0)).alias("n_calls"), F.coalesce(F.percentile("n_calls", 0.5), F.lit(0.0)).alias("median_calls"), F.coalesce(F.max("n_calls"), F.lit(0)).alias("most_calls"))
    report |= calls.first().asDict()
    times = runs.where("ms is not null")
    stages = comparison.latency(times.select("stage", "ms"), ["stage"], "ms").collect()
    report["latency_ms"] = {r.stage: {"median": round(r.median_ms, 3), "p90": round(r.p90_ms, 3), "slowest": round(r.max_ms, 3)} for r in sorted(stages)}
    found = expected.sparkSession.read.parquet(path)
    report["per_check"] = {r.field: {s: r[f"n_{s}"] for s in sorted(comparison.SEVERITY)} for r in sorted(comparison.status_counts(found).collect())}
    return report


def differences(path: str, spark) -> DataFrame:
    """Of a written report, the cases whose statuses are not the expected ones, with what differs."""
    rows = spark.read.parquet(path)
    return comparison.differences(rows.select("doc_id", "field", "expected_status"), rows.where("status is not null"))


def check(report: dict, gates: tuple[Gate, ...] = GATES) -> None:
    """Raise ``GateError`` if a total does not stand to its bound as it must; a total that a report lacks misses its gate."""
    missed = [(name, report.get(name), how, bound) for name, how, bound in gates if report.get(name) is None or not _HOLDS[how](report[name], bound)]
    if missed:
        raise GateError(missed)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True)


def summary(report: dict) -> str:
    """The report in a few lines."""
    lines = [
        f"cases {report['n_cases']}, checks {report['n_expectations']}, exact {report['n_exact']} ({report['accuracy']:.1%})",
        f"readings {report['n_calls']}, a case: median {report['median_calls']:.1f}, most {report['most_calls']}",
        f"false matches {report['n_false_match']}, false mismatches {report['n_false_mismatch']}, missed matches {report['n_missed_match']}",
        f"reviews {report['n_review']}, not found {report['n_not_found']}, failures {report['n_failures']}",
    ]
    return "\n".join(lines + [f"{s}: median {t['median']:.1f} ms, p90 {t['p90']:.1f} ms, slowest {t['slowest']:.1f} ms" for s, t in report["latency_ms"].items()])
