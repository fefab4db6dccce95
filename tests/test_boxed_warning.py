"""The warning checks of labels with boxes, from words to statuses."""

import pytest
from pyspark.sql import functions as F

from docproof.operators import layout, pixels, warning
from docproof.plans.label_data import CLAUSES, HEADING
from docproof.plans.stages import cut

WORDS = "doc_id int, ordinal int, page int, block int, paragraph int, line int, left int, top int, width int, height int, confidence double, text string, image_width int, image_height int"
WHOLE = f"{HEADING}: {' '.join(CLAUSES)}"
#: Six words a row, 20 high, 40 apart.
ROW, TOP = 6, 200


def label(doc, text, apart=40, other=(20, 20), confidence=0.95, page=1):
    words = [(doc, 0, 1, 1, 1, 0, *other, 90, 20, 0.9, "BRAND", 1000, 800)]
    for k, w in enumerate(text.split()):
        row, at = divmod(k, ROW)
        x = x + 12 if at else 20
        words.append((doc, k + 1, page if row > 2 else 1, 1, 1, row + 1, x, TOP + apart * row, 8 * len(w), 20, confidence, w, 1000, 800))
        x += 8 * len(w)
    return words


LABELS = {
    1: dict(text=WHOLE), 2: dict(text=WHOLE, other=(20, TOP - 22)), 3: dict(text=WHOLE, apart=75), 4: dict(text=WHOLE, page=2), 5: dict(text=WHOLE.replace("risk", "r1sk")),
    6: dict(text=WHOLE.replace("machinery", "spaceships")), 7: dict(text=WHOLE.replace("machinery", "spaceships"), confidence=0.6), 8: dict(text="PLAIN WORDS OF A LABEL"), 9: dict(text=WHOLE.replace(HEADING, "Government Warning")),
}


def ink(doc, words):
    """Pixels of a white page: bars of 4 in the heading and of 2 elsewhere, 2 pixels from a word's edges."""
    dark = {}
    for w in words[1:]:
        left, top, width, height = w[6:10]
        bar = 4 if w[1] < 3 else 2
        for x in range(left + 2, left + width - 2):
            if (x - left - 2) % 8 < bar:
                dark |= {(x, y): 0 for y in range(top + 2, top + height - 2)}
    right, bottom = max(w[6] + w[8] for w in words) + 5, max(w[7] + w[9] for w in words) + 20
    return [(doc, x, y, dark.get((x, y), 255)) for y in range(TOP - 20, bottom) for x in range(15, right)]


@pytest.fixture(scope="module")
def words(spark):
    return cut(spark.createDataFrame([w for d, k in LABELS.items() for w in label(d, **k)], WORDS))


@pytest.fixture(scope="module")
def status(spark, words):
    volumes = spark.createDataFrame([(d, 750.0) for d in LABELS], "doc_id int, ml double")
    rows = cut(warning.analyse(words, volumes))
    whole = {r.doc_id: (r.automated_status, r.overall_status) for r in warning.statuses(rows).collect()}
    each = {d: {} for d in LABELS}
    for r in rows.collect():
        each[r.doc_id][r.check] = r.status
    return each, whole


def test_statements_are_put_together_from_boxes(words):
    rows = {r.doc_id: r for r in warning.located(words).collect()}
    assert sorted(rows) == sorted(LABELS) and rows[1].statement == WHOLE and rows[1].boxed and not rows[8].boxed and not rows[8].found
    assert len(rows[1].confidences) == len(rows[1].words) and rows[1].source_lines[0] == " ".join(WHOLE.split()[:ROW])
    box = warning.measured(warning.located(words), words).where("doc_id = 1").first()
    assert tuple(box.box)[:2] == (20, TOP) and box.n_parts == len(WHOLE.split()) and box.mean_confidence == pytest.approx(0.95) and box.complete


def test_each_check(status):
    each, whole = status
    assert {d: s["continuous_statement"] for d, s in each.items()} == {1: "match", 2: "match", 3: "review", 4: "review", 5: "match", 6: "match", 7: "match", 8: "not_found", 9: "match"}
    assert {d: s["separation"] for d, s in each.items() if s["separation"] != "match"} == {2: "review", 8: "not_found"}
    assert {d: s["wording"] for d, s in each.items() if s["wording"] != "match"} == {5: "review", 6: "mismatch", 7: "review", 8: "not_found"}
    assert {d: s["heading_capitalization"] for d, s in each.items() if s["heading_capitalization"] != "match"} == {8: "not_found", 9: "mismatch"}
    assert each[1]["presence"] == "match" and each[1]["heading_boldness"] == each[1]["legibility_contrast"] == "review"
    assert whole[1] == ("review", "review") and whole[6] == ("mismatch", "mismatch") and whole[8] == ("not_found", "not_found")


def test_separation_is_from_the_box_around_the_statement(spark):
    """A word between rows lies within the box, however far it is from each of the statement's words."""
    rows = [(1, k, 0, y, 50, 10) for k, y in enumerate((0, 200, 100))]
    words = spark.createDataFrame(rows, "doc_id int, ordinal int, left int, top int, width int, height int")
    region = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, ordinal int")
    assert layout.nearest_other(words, region).first().distance == 0.0
    alone = layout.nearest_other(words, spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id int, ordinal int")).first()
    assert alone.distance is None


def test_a_label_that_matches_as_a_whole(spark):
    """With pixels all that a picture shows can match; then only the ruler's checks are open."""
    own = label(1, WHOLE, apart=40)
    volumes = spark.createDataFrame([(1, 750.0)], "doc_id int, ml double")
    page = cut(spark.createDataFrame(ink(1, own), "doc_id int, x int, y int, level int"))
    rows = cut(warning.analyse(cut(spark.createDataFrame(own, WORDS)), volumes, None, page, 800))
    status = {r.check: r.status for r in rows.collect()}
    assert {c for c, s in status.items() if s != "match"} == {"type_size", "characters_per_inch"}
    whole = warning.statuses(rows).first()
    assert (whole.automated_status, whole.manual_confirmation_required, whole.overall_status) == ("match", True, "review")


def test_crops_over_tiles(spark):
    page = spark.createDataFrame([(d, x, y, (x + y) % 256) for d in (1, 2) for x in range(140) for y in range(70)], "doc_id int, x int, y int, level int")
    boxes = spark.createDataFrame([(1, "a", 60, 60, 10, 8), (1, "b", 0, 0, 140, 2), (2, "c", 63, 63, 1, 1), (1, "none", 5, 5, 0, 9)], "doc_id int, crop string, left int, top int, width int, height int")
    got = pixels.crops(page, boxes)
    assert {r.crop: (r.n, r.x, r.y) for r in got.groupBy("crop").agg(F.count("*").alias("n"), F.min("x").alias("x"), F.max("y").alias("y")).collect()} == {"a": (80, 60, 67), "b": (280, 0, 1), "c": (1, 63, 63)}
