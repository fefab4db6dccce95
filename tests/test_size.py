"""What larger tables need: work dealt over tasks, and texts and lines read in time linear in their length."""

import time

from docproof.functions import text as T
from docproof.operators import extraction, warning
from docproof.plans import label_data
from docproof.sources import response
from pyspark.sql import functions as F
from test_boxed_warning import WORDS

SF = "/root/testdata/sf0.001"


def test_applications_of_one_file_are_many_tasks(spark):
    apps = label_data.applications(spark, SF)
    sizes = [len(p) for p in apps.select("doc_id").rdd.glom().collect()]
    assert len(sizes) == 8 and min(sizes) > 0 and max(sizes) <= 0.5 * sum(sizes)


def test_addresses_in_long_lines(spark):
    """The pattern with a whole run of letters before the state took time quadratic in a line's length."""
    long = "word and " * 4000
    rows = {"LOUISVILLE, KY": True, "Nashville TN 37201": True, "St. Paul. Minnesota": True, "x, STATE": True, ", KY": False, "KY": False, "a KY.": False, "12 Main Street": True, "LOUISVILLE,KY": True, "1,KY": False, " KY": False, "  KY": True, long: False, f"{long}Ohio": True, f"{long}KY": True, f"{long}KY 4020": False}
    began = time.time()
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.col("t").rlike(extraction.ADDRESS).alias("a")).collect()
    assert {r.t: r.a for r in got} == rows and time.time() - began < 30


def test_lines_without_numbers_have_no_candidates(spark):
    rows = [("40% ABV", 1, 0), ("40 Percent alcohol by volume", 1, 0), ("45 alc vol", 0, 0), ("1 PINT 9 FL OZ (739 mL)", 0, 1), ("1 pint 4 left", 0, 0), ("750 ml or 1 L", 0, 2), ("no number", 0, 0), ("", 0, 0)]
    lines = spark.createDataFrame([(1, k, t) for k, (t, _, _) in enumerate(rows)], "doc_id int, line_number int, text string")
    got = lines.select("line_number", F.size(extraction.abv_of(F.col("text"), F.col("line_number"))).alias("a"), F.size(extraction.volumes_of(F.col("text"), F.col("line_number"))).alias("v")).orderBy("line_number").collect()
    assert [(r.a, r.v) for r in got] == [(a, v) for _, a, v in rows]


def test_phrases(spark):
    words = [["health", "problems"], ["a", "health", "problems", "b"], ["health", "health", "problems"], ["health"], ["ahealth", "problems"], []]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").select(T.has_phrase(F.col("w"), ["health", "problems"]).alias("h"), T.phrase_index(F.col("w"), ["health", "problems"]).alias("i")).collect()
    assert [(r.h, r.i) for r in got] == [(True, 0), (True, 1), (True, 1), (False, None), (False, None), (False, None)]


def test_an_alignment_is_made_once(spark):
    warning._opcodes.cache_clear()
    words = ("government", "warning", "1", "strange")
    assert warning._opcodes(words) is warning._opcodes(words) and warning._opcodes.cache_info().maxsize == warning.REMEMBERED


def test_a_response_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"engine": "plain"}',)], "response string")
    for f in (response.shape_errors, response.check_statuses):
        shown = rows.select(f(F.col("response")).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
        assert shown.lower().replace("_", "").count("parsejson") == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_warnings_are_split_once(spark):
    """Split inside the function that places a word, a warning was split again for each of its words."""
    assert _plan(label_data.warning_words(spark, SF)).count("split(") == 1


def test_labels_with_boxes_are_put_together_once(spark):
    """Words were read 21 times, and every statement aligned twice."""
    words = spark.createDataFrame([], WORDS)
    plan = _plan(warning.analyse(words, spark.createDataFrame([], "doc_id int, ml double")))
    assert plan.count("LogicalRDD [doc_id") <= 6 and plan.count("ArrowEvalPython [alignment(") == 1
