"""Reading services with typed failures, regions read again, images as a source, and held-out crops."""

import json

import pytest
import services
from docproof.operators import comparison, extraction, layout, refinement
from docproof.sources import crops, reading
from pyspark.sql import functions as F
from test_refinement import APPLICATION, LABEL, OWN, WORDS, words_of

IMAGES = "doc_id int, content binary, media_type string"


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    spark.sparkContext.addPyFile(services.__file__)


def test_failures_are_codes_of_their_own_image(spark):
    rows = [(1, b"one two\n\nthree", "text/plain"), (2, b"slow", None), (3, b"late", None), (4, b"down", None), (5, b"\xff\xfe", None), (6, None, None), (7, b"", None), (1, b"again", None)]
    got = reading.read(spark.createDataFrame(rows, IMAGES), services.Odd(), seconds=1.0)
    out = sorted((r.doc_id, r.text or "", r.error or "") for r in got.outcomes.collect())
    assert out == [(1, "again", ""), (1, "one two\nthree", ""), (2, "", "timeout"), (3, "", "timeout"), (4, "", "unavailable"), (5, "", "processing"), (6, "", "processing"), (7, "", "")]
    assert all("secret" not in str(r) for r in got.outcomes.collect())
    words = got.words.where("doc_id = 1 and text <> 'again'").orderBy("ordinal").collect()
    assert [(w.text, w.left, w.top, w.width, w.line, w.image_width, w.image_height) for w in words] == [("one", 0, 0, 30, 0, 70, 60), ("two", 40, 0, 30, 0, 70, 60), ("three", 0, 40, 50, 2, 70, 60)]


def test_no_images_and_words_without_ids(spark):
    none = reading.read(spark.createDataFrame([], IMAGES), services.Odd())
    assert none.outcomes.collect() == [] and none.words.collect() == []
    assert reading.read(spark.createDataFrame([(1, b"x", None)], IMAGES), services.Ignored()).outcomes.first().text == "a\na\nb"


def test_regions_are_read_where_a_service_can(spark):
    images = spark.createDataFrame([(1, b"AAA BBB\nCCC DDD", None), (2, b"\xff", None)], IMAGES)
    assert reading.region_reader(images, services.WholeOnly()) is None
    plans = [(1, "brand_name", 0, 0, 35, 20, 6), (1, "class_type", 40, 20, 35, 20, 7), (2, "brand_name", 0, 0, 9, 9, 6), (3, "brand_name", 0, 0, 9, 9, 6)]
    planned = spark.createDataFrame(plans, "doc_id int, field string, left int, top int, width int, height int, mode int")
    got = reading.region_reader(images, reading.PlainPages())(planned)
    assert sorted((r.doc_id, r.field, r.text, r.error) for r in got.outcomes.collect()) == [(1, "brand_name", "AAA", None), (1, "class_type", "DDD", None), (2, "brand_name", None, "processing"), (3, "brand_name", None, "processing")]
    assert [(w.field, w.text, w.left, w.top) for w in got.words.orderBy("field").collect()] == [("brand_name", "AAA", 0, 0), ("class_type", "DDD", 0, 0)]


def test_refinement_through_a_service(spark):
    lines = layout.read_lines(spark.createDataFrame(words_of(1, LABEL), WORDS))
    apps = spark.createDataFrame([OWN], APPLICATION)
    candidates = extraction.extract(lines)
    results = comparison.compare(apps, candidates)
    images = spark.createDataFrame([(1, b"", None)], IMAGES)
    without = refinement.refine(apps, candidates, results, lines, reading.region_reader(images, services.WholeOnly()))
    assert without.results.count() == results.count() and without.evidence.count() == without.calls.count() == 0
    done = refinement.refine(apps, candidates, results, lines, reading.region_reader(images, services.Finer()))
    assert done.evidence.columns == without.evidence.columns and done.calls.columns == without.calls.columns
    chosen = {r.field: r.selected for r in done.evidence.collect()}
    assert chosen["class_type"]
    assert done.results.where("field = 'class_type'").first().status == "match"


def test_images_as_a_source(spark, tmp_path):
    reading.register(spark)
    (tmp_path / "more").mkdir()
    for k in range(5):
        (tmp_path / "more" / f"{k}.txt").write_text(f"label {k}")
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    (tmp_path / "notes.json").write_text("{}")
    load = lambda **o: spark.read.format("label_words").options(path=str(tmp_path), suffixes="txt", files_per_task=2, **o).load()
    rows = {r.path.rsplit("/", 1)[1]: r for r in load().collect()}
    assert sorted(rows) == ["0.txt", "1.txt", "2.txt", "3.txt", "4.txt", "bad.txt"]
    assert rows["3.txt"].text == "label 3" and [w.text for w in rows["3.txt"].words] == ["label", "3"] and rows["bad.txt"].error == "processing" and rows["bad.txt"].words is None
    one = load(service="services:Odd").where(F.col("path").isin(f"{tmp_path}/more/1.txt", f"{tmp_path}/none.txt"))
    assert [r.text for r in one.collect()] == ["label 1"]
    assert one.rdd.getNumPartitions() == 1
    assert [r.text for r in load().where((F.col("path") == f"{tmp_path}/more/2.txt") & (F.col("image_width") > 0)).collect()] == ["label 2"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


EVIDENCE = {
    "heldout": [
        {"name": "front", "source": "https://host/a/b/one.jpg?x=1#y", "crop": [100, 50, 400, 250]},
        {"name": "", "source": "one.jpg", "crop": [0, 0, 1, 1]},
        {"name": "n", "source": "https://host/", "crop": [0, 0, 1, 1]},
        {"name": "n", "source": "one.jpg", "crop": [0, 0, 1]},
        {"name": "n", "source": "one.jpg", "crop": [5, 0, 5, 1]},
        {"name": "n", "source": "one.jpg", "crop": None, "note": "extra"},
    ],
    "other": 1,
}


def test_crops_of_a_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(EVIDENCE, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"heldout": []}')
    rows = crops.read_crops(spark, str(tmp_path)).orderBy("path", "position").collect()
    assert [(r.path[-6:], r.position, r.image, r.error) for r in rows] == [
        ("a.json", 0, "one.jpg", None), ("a.json", 1, "one.jpg", "name is missing"), ("a.json", 2, "", "source is missing"), ("a.json", 3, "one.jpg", "crop must be four numbers"),
        ("a.json", 4, "one.jpg", "crop is empty"), ("a.json", 5, "one.jpg", "crop must be four numbers"), ("b.json", None, None, "no crop"), ("c.json", None, None, "no crop"),
    ]
    assert tuple(rows[0][c] for c in ("left", "top", "width", "height")) == (100, 50, 300, 200)


def test_words_of_crops_equal_brute_force(spark):
    words = [(d, k, 1, 1, 1, k % 7, (k * 137) % 900, (k * 61) % 700, 10 + k % 50, 20, 0.9, f"w{k}", 1000, 800) for d in (1, 2) for k in range(120)]
    words.append((1, 999, 1, 1, 1, 1, None, None, None, None, 0.9, "unboxed", 1000, 800))
    regions = [(1, 10, 0, 0, 1000, 800), (1, 11, 250, 200, 263, 300), (1, 12, 250, 200, 263, 300), (2, 20, 100, 100, 0, 5), (3, 30, 0, 0, 10, 10)]
    got = crops.words_in(spark.createDataFrame(regions, "doc_id int, crop int, left int, top int, width int, height int"), spark.createDataFrame(words, WORDS))
    want = []
    for d, crop, x, y, w, h in regions:
        for r in words:
            if r[0] == d and r[6] is not None and x <= r[6] + r[8] / 2 < x + w and y <= r[7] + r[9] / 2 < y + h:
                left, top = max(r[6] - x, 0), max(r[7] - y, 0)
                want.append((crop, r[1], left, top, min(r[6] + r[8] - x, w) - left, min(r[7] + r[9] - y, h) - top, w, h))
    assert sorted((r.doc_id, r.ordinal, r.left, r.top, r.width, r.height, r.image_width, r.image_height) for r in got.collect()) == sorted(want)


def test_a_crop_without_words_has_no_warning(spark):
    regions = spark.createDataFrame([(1, 10, 0, 0, 10, 10)], "doc_id int, crop int, left int, top int, width int, height int")
    checks = crops.checked(regions, spark.createDataFrame(words_of(1, LABEL), WORDS))
    assert {r.check: r.status for r in checks.collect()}["presence"] == "not_found"
    counts = crops.report(spark.createDataFrame([(10, "heldout")], "doc_id int, group string"), checks)
    assert {r.check: r.n_not_found for r in counts.collect()}["presence"] == 1


@pytest.mark.parametrize("service", ["docproof.sources.reading:PlainPages", "services:WholeOnly"])
def test_a_service_is_known_by_what_it_can(service):
    assert isinstance(reading.named(service), reading.RegionalService) == service.endswith("PlainPages")
