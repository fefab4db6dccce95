"""Generated cases: kinds by id and seed, their lines, and what a run that is wrong looks like."""

from docproof.operators import comparison, evaluation
from docproof.plans import cases
from pyspark.sql import functions as F
from test_refinement import APPLICATION

OWN = ("Stone Hollow", "Straight Bourbon Whiskey", 45.0, "750 mL", "Stone Hollow LLC", "Louisville, Kentucky", False, None)


def made(spark, seed=0, n=len(cases.KINDS)):
    return cases.cases(spark.createDataFrame([(k, *OWN) for k in range(n)], APPLICATION), seed)


def test_kinds_turn_with_the_seed(spark):
    kinds = lambda seed: [r.kind for r in made(spark, seed).orderBy("doc_id").collect()]
    assert kinds(0) == list(cases.KINDS) and kinds(3) == [*cases.KINDS[3:], *cases.KINDS[:3]] and kinds(-1)[1:] == list(cases.KINDS[:-1])


def test_lines_of_kinds(spark):
    lines = {r.kind: r.lines for r in made(spark).collect()}
    clean = lines["clean_domestic"]
    assert clean[:6] == ["STONE HOLLOW", "Straight Bourbon Whiskey", "45.0% ABV", "750 mL", "BOTTLED BY Stone Hollow LLC", "LOUISVILLE, KY"] and len(clean) == 8
    assert lines["wrong_abv_and_volume"][2:4] == ["40% ABV", "375 mL"] and "45.0% ABV" not in lines["missing_abv"]
    assert lines["wrapped_producer"][4:6] == ["BREWED BY", "Stone Hollow LLC"] and lines["missing_warning"] == clean[:6]
    assert "PRODUCT OF FRANCE" in lines["clean_imported"] and "PRODUCT OF SPAIN" in lines["wrong_country"] and not any(x.startswith("PRODUCT OF") for x in lines["missing_import_origin"])
    assert lines["altered_warning_wording"][-1].endswith("health benefits.") and lines["warning_heading_case"][-2].startswith("Government Warning: (1)")


def test_empty_fields_and_no_applications(spark):
    rows = spark.createDataFrame([(0, None, None, None, None, None, None, None, None)], APPLICATION)
    assert cases.cases(rows).first().lines[0] == "LOUISVILLE, KY"
    none = made(spark, n=0)
    assert none.collect() == [] and cases.expected(none).collect() == []


def test_a_wrong_run_is_seen(spark):
    own = made(spark)
    expected = cases.expected(own)
    assert expected.count() == len(cases.KINDS) * 10
    blind = expected.select("doc_id", "field", F.lit("match").alias("status"))
    told = evaluation.judged(expected, blind)
    wrong = {(r.kind, r.field) for r in told.where("verdict = 'false_match'").collect()}
    assert wrong >= {(k, f) for k, own in cases.EXPECTED.items() for f in own} and ("clean_domestic", "country_origin") in wrong
    assert set(comparison.FIELDS) == set(cases.FIELDS)
