"""Regions to read again and which readings replace the first, on small labels with boxes."""

import pytest
from docproof.operators import comparison, extraction, layout, refinement
from docproof.plans.stages import cut

WORDS = "doc_id int, ordinal int, page int, block int, paragraph int, line int, left int, top int, width int, height int, confidence double, text string, image_width int, image_height int"
APPLICATION = "doc_id int, brand_name string, class_type string, abv double, net_contents string, producer_name string, producer_address string, imported_product boolean, country_origin string"


def words_of(doc, lines, size=(1600, 1200), more=()):
    """Words of lines (text, left, top, height, confidence), 18 wide a letter."""
    out = []
    for k, (text, left, top, height, confidence) in enumerate(lines):
        x = left
        for w in text.split():
            width = max(25, 18 * len(w))
            out.append((doc, len(out), *more, 1, 1, 1, k, x, top, width, height, confidence, w, *size))
            x += width + 16
    return out


LABEL = [
    ("Stone 8 Hollow", 100, 200, 90, 0.65), ("Distillery", 100, 300, 90, 0.9), ("Straight bourbon Whiskev ©", 100, 500, 75, 0.65), ("BATCH #1", 150, 590, 35, 0.9),
    ("ornamental smudged ribbon", 220, 760, 55, 0.9), ("40% ALCOHOL BY VOLUME", 250, 910, 35, 0.9),
]
OWN = (1, "Stone & Hollow Distillery", "Straight Bourbon Whiskey", 40.0, "500 mL", "Example", "Louisville, KY", False, None)


GOOD = {"net_contents": ("1 PINT 0.9 FL OZ (500 ML)", 0.9), "brand_name": ("Stone & Hollow\nDistillery", 0.9), "class_type": ("Straight Bourbon Whiskey o®", 0.9)}
FAILS = {"net_contents": ("x", None), "class_type": ("x", None)}
AT = "Stone @ Hollow Distillery"
#: Readings of one label, by field: text with its confidences, or an error.
SAID = {
    1: GOOD,
    2: {"net_contents": ("smudged ribbon", 0.9), "brand_name": ("Stone and Something Else", 0.2), "class_type": ("Vodka", 0.9)},
    3: {"net_contents": ("timeout", None), "brand_name": ("Stone & Hollow Distillery", 0.9), "class_type": ("unavailable", None)},
    4: {"net_contents": ("700 ML", 0.9), "brand_name": (AT, 0.9), "class_type": ("x", None)},
    5: {"net_contents": ("700 ML", 0.9), "brand_name": (AT, 0.9), "class_type": ("x", None)},
}
#: Readings of the brand: it must be surer word by word, and about the same text.
CASES = [
    ("Stone & Hollow Distillery", [0.99, 0.2, 0.99, 0.99], False), ("Stone & Hollow Distillery", [0.99, None, 0.99, 0.99], False), ("Stone 8 Hollow Distillery", 0.66, False), ("Stone & Hollow Distillery", 0.8, True),
    ("Stone & Hollow Distillery", [0.99, 0.99, 0.99, 0.55], True), ("Stone", 0.99, False), ("Marble @ Hill Brewers", 0.99, False), (AT, 0.9, True),
]
SAID |= {10 + k: FAILS | {"brand_name": c[:2]} for k, c in enumerate(CASES)}


@pytest.fixture(scope="module")
def label(spark):
    lines = cut(layout.read_lines(spark.createDataFrame([w for d in SAID for w in words_of(d, LABEL)], WORDS)))
    applications = spark.createDataFrame([(d, AT if d == 4 else OWN[1], *OWN[2:]) for d in SAID], APPLICATION)
    candidates = cut(extraction.extract(lines))
    return applications, candidates, cut(comparison.compare(applications, candidates)), lines


def reader(spark, said):
    def read(planned):
        out, words = [], []
        for p in planned.select("doc_id", "field").collect():
            text, confidence = said[p.doc_id][p.field]
            if confidence is None:
                out.append((p.doc_id, p.field, None, 0.0, text))
                continue
            out.append((p.doc_id, p.field, text, 12.0, None))
            parts = [(t, 10, 10 + 60 * k, 40, 0.9) for k, t in enumerate(text.split("\n"))]
            own = words_of(p.doc_id, parts, (800, 150), (p.field,))
            levels = confidence if isinstance(confidence, list) else [confidence] * len(own)
            words += [(*w[:11], c, *w[12:]) for w, c in zip(own, levels)]
        kind = WORDS.replace("ordinal int,", "ordinal int, field string,")
        return refinement.Reading(spark.createDataFrame(out, "doc_id int, field string, text string, duration_ms double, error string"), spark.createDataFrame(words, kind))

    return read


@pytest.fixture(scope="module")
def refined(spark, label):
    """Rows of everything that one run over all labels gives, by label."""
    done = refinement.refine(*label, reader(spark, SAID))
    return {name: {d: [r for r in rows if r.doc_id == d] for d in SAID} for name, rows in ((n, getattr(done, n).collect()) for n in done._fields)}


def selected(refined, doc):
    return {r.field: r.selected for r in refined["evidence"][doc]}


def by_field(df, *columns):
    return {r.field: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_plans(spark, label):
    _, candidates, results, lines = label
    got = {p.field: p for p in refinement.plans(results, candidates, lines).where("doc_id = 1").collect()}
    assert {f: (p.mode, p.source_lines) for f, p in got.items()} == {"net_contents": (7, []), "brand_name": (6, [1, 2]), "class_type": (7, [3])}
    #: The partner of the line of strength is the ribbon, with its margins.
    assert tuple(got["net_contents"][c] for c in refinement.BOX) == (220 - 36, 748, 446 + 72, 79)
    assert got["brand_name"].left < 100 and got["brand_name"].top < 200 and got["brand_name"].top + got["brand_name"].height > 390 and got["class_type"].top == 500 - 26
    assert got["brand_name"].text_height == 90.0 and got["net_contents"].text_height is None and got["brand_name"].full_image_candidates == ["Stone 8 Hollow Distillery"]


def test_plans_leave_regions_and_strong_fields_alone(spark, label):
    applications, candidates, results, lines = label
    region = spark.createDataFrame([(1, 0, 0, 1600, 700)], "doc_id int, left int, top int, width int, height int")
    assert [p.field for p in refinement.plans(results, candidates, lines, region).where("doc_id = 1").collect()] == ["net_contents"]
    clear = [(t, 100, 100 * k, 40, 0.9) for k, t in enumerate(("Stone & Hollow Distillery", "Straight Bourbon Whiskey", "40% ABV", "500 ML", "Bottled by Example", "Louisville, KY"), 1)]
    own = cut(layout.read_lines(spark.createDataFrame(words_of(1, clear), WORDS)))
    found = cut(extraction.extract(own))
    assert refinement.plans(cut(comparison.compare(applications, found)), found, own).where("doc_id = 1").count() == 0


def test_partner_of_a_volume(spark):
    """The nearest wide line of the panel that no candidate stands on; a very far, a narrow and an occupied one are none."""
    lines = [("GOLDEN BARREL", 100, 60, 60, 0.9), ("far plain decorated words", 100, 300, 40, 0.9), ("12 12", 100, 820, 40, 0.9), ("~ ~ ~ ~ ~ ~ ~ ~ ~ ~", 100, 700, 40, 0.9), ("40% ALC/VOL", 100, 860, 40, 0.9)]
    table = cut(layout.read_lines(spark.createDataFrame(words_of(1, lines), WORDS)))
    candidates = cut(extraction.extract(table))
    results = spark.createDataFrame([(1, "net_contents", "not_found")], "doc_id int, field string, status string")
    plan = refinement.plans(results, candidates, table).collect()
    assert [(p.field, p.top, p.top + p.height) for p in plan] == [("net_contents", 688, 752)]
    assert refinement.plans(results, candidates.where("field <> 'abv'"), table).count() == 0


def test_accepted_readings(refined):
    assert {r.field: r.refined_text for r in refined["evidence"][1]}["class_type"] == "Straight Bourbon Whiskey o®"
    assert selected(refined, 1) == dict.fromkeys(refinement.ORDER, True)
    status = {r.field: r for r in refined["results"][1]}
    assert {f: status[f].status for f in refinement.ORDER} == dict.fromkeys(refinement.ORDER, "match") and len(status) == 7
    assert status["net_contents"].extracted_raw == "1 PINT 0.9 FL OZ (500 ML)" and status["class_type"].extracted_raw == "Straight Bourbon Whiskey"
    (calls,) = refined["calls"][1]
    assert (calls.n_calls, calls.duration_ms, calls.warnings) == (3, 36.0, [])


def test_refused_readings_keep_the_first(refined, label):
    assert selected(refined, 2) == dict.fromkeys(refinement.ORDER, False)
    for name, before in (("results", label[2]), ("candidates", label[1])):
        assert sorted(map(str, refined[name][2])) == sorted(str(r) for r in before.select(*refined[name][2][0].__fields__).where("doc_id = 2").collect())


def test_failed_readings_are_counted(refined):
    (calls,) = refined["calls"][3]
    assert (calls.n_calls, calls.duration_ms) == (3, 12.0) and len(calls.warnings) == 2 and "net_contents" in calls.warnings[1]
    assert selected(refined, 3) == {"brand_name": True}


def test_acceptance_does_not_look_at_the_application(refined):
    for doc, status in ((4, "match"), (5, "review")):
        got = {r.field: r.status for r in refined["results"][doc]}
        assert selected(refined, doc) == {"net_contents": True, "brand_name": True} and got["brand_name"] == status and got["net_contents"] == "mismatch"


@pytest.mark.parametrize("k", range(len(CASES)))
def test_a_reading_must_be_surer_word_by_word_and_about_the_same_text(refined, k):
    assert selected(refined, 10 + k) == {"brand_name": CASES[k][2]}


def test_a_small_line_beside_a_large_one_is_kept(spark):
    """A low, legible line under a brand may vanish from a reading of the block; the reading then stands for both."""
    lines = [("OAKRIDGE", 100, 200, 120, 0.6), ("ESTATE CELLARS", 100, 330, 30, 0.95), ("London Dry Gin", 100, 600, 40, 0.95), ("40% ABV", 100, 700, 40, 0.95), ("700 ML", 100, 800, 40, 0.95)]
    table = cut(layout.read_lines(spark.createDataFrame(words_of(1, lines), WORDS)))
    candidates = cut(extraction.extract(table))
    results = spark.createDataFrame([(1, "brand_name", "review")], "doc_id int, field string, status string")
    planned = cut(refinement.plans(results, candidates, table))
    plan = planned.first()
    assert plan.source_lines == [1, 2] and [r.text for r in plan.retained] == ["ESTATE CELLARS"] and plan.text_height is None
    assert plan.left == 100 - 60
    for text, raw in (("OAKRIDGE", "OAKRIDGE ESTATE CELLARS"), ("OAKRIDGE ESTATE CELLARS", "OAKRIDGE ESTATE CELLARS")):
        row = refinement.judged(planned, candidates, table, reader(spark, {1: {"brand_name": (text, 0.9)}})(planned)).first()
        assert row.after.raw_value == raw  # the two candidates of its lines together are longer, so it is not selected


def test_reader_over_a_word_table(spark, label):
    _, candidates, results, lines = label
    finer = [("Stone & Hollow", 100, 200, 90, 0.95), ("Distillery", 100, 300, 90, 0.95), ("Straight Bourbon Whiskey", 100, 500, 75, 0.95)]
    read = refinement.from_words(spark.createDataFrame(words_of(1, finer), WORDS))
    got = {r.field: (r.text, r.error) for r in read(refinement.plans(results, candidates, lines)).outcomes.where("doc_id = 1").collect()}
    assert got == {"net_contents": (None, "processing"), "brand_name": ("Stone & Hollow\nDistillery", None), "class_type": ("Straight Bourbon Whiskey", None)}
