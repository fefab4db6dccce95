"""Goldens of the core library: values, lines, warning checks, sources and sinks, on small rows."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from docproof import streaming
from docproof.functions import text as T
from docproof.operators import comparison, extraction, layout, pixels, warning
from docproof.plans.label_data import CLAUSES, HEADING
from docproof.sources import manifest, records

WHOLE = f"{HEADING}: {' '.join(CLAUSES)}"


def chunk(kind, data):
    return struct.pack(">I4s", len(data), kind) + data + b"crc."


def png(width, height, more=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + more + chunk(b"IDAT", b"data") + chunk(b"IEND", b"")


def jpeg(width, height):
    part = lambda marker, data: struct.pack(">BBH", 255, marker, len(data) + 2) + data
    return b"\xff\xd8" + part(0xE0, b"JFIF\0") + part(0xC4, b"tables") + b"\xff" + part(0xC2, struct.pack(">BHHB", 8, height, width, 3)) + part(0xDA, b"scan") + b"\x12\xff\x00\x34\xff\xd9"


def webp(width, height, frames=0):
    part = lambda kind, data: struct.pack("<4sI", kind, len(data)) + data + b"\0" * (len(data) % 2)
    size = lambda n: (n - 1).to_bytes(3, "little")
    body = part(b"VP8X", bytes([2, 0, 0, 0]) + size(width) + size(height)) + part(b"ANMF", b"frame") * frames if frames else part(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", width, height) + b"data")
    return struct.pack("<4sI4s", b"RIFF", len(body) + 4, b"WEBP") + body


def one(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_text_keys(spark):
    assert one(spark, T.text_key, "  STONE'S   THROW  ", "Stone’s Throw", "Stone—Throw", "OLD.TOM, DISTILLERY", "ＣＡＦÉ", "MALT＆HOP", "Malt @ Hop", "A+B", "O´Brien", None) == [
        "stones throw", "stones throw", "stone throw", "old tom distillery", "café", "malt & hop", "malt @ hop", "a + b", "o brien", None,
    ]
    assert one(spark, T.address_key, "Louisville, Kentucky", "LOUISVILLE KY", "Charleston, West Virginia", "Washington, District of Columbia", "Richmond Virginia") == ["louisville ky", "louisville ky", "charleston wv", "wa dc", "richmond va"]
    assert one(spark, T.country_key, " U.S.A. ", "United States of America", "France") == ["united states", "united states", "france"]
    assert one(spark, lambda c: T.address_state(T.address_key(c)), "Louisville, Kentucky 40202", "Louisville") == ["ky", None]
    assert one(spark, T.warning_key, "“A” –  b ： c .") == ["“a” - b: c."]


def test_numbers(spark):
    assert one(spark, T.abv, "45", "45.0", "45%", "0", "101", "not a number") == [45.0, 45.0, 45.0, None, None, None]
    assert one(spark, T.volume, "750 mL", "1 L", "1 PINT", "16 FL OZ", "1 gallon", "0 mL", "７５０ ml") == [750.0, 1000.0, 473.176473, 473.176473, None, None, 750.0]
    assert one(spark, T.label_volume, "750 ML", "1 PINT (473 ML)", "text") == [750.0, 473.0, None]
    values = [123456.789, 45.0, 0.5, 473.176473, 1e7, 0.00001234, 0.0, 999999.7, 100.0]
    assert one(spark, T.number_label, *values, kind="double") == [f"{v:g}" for v in values]
    assert [tuple(t) for t in one(spark, T.physical_tier, 237.0, 237.1, 3000.0, 3000.1, kind="double")] == [(1, 40), (2, 25), (2, 25), (3, 12)]
    assert one(spark, T.filename_key, "C:\\labels\\Café.JPG", "cafe\u0301.jpg") == ["café.jpg", "café.jpg"]
    assert one(spark, lambda c: T.approximate_phrase_index(T.tokens(c), ["surgeon", "general"]), "the surge0n general", "no") == [1, None]


def lines(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "doc_id int, line_number int, text string")


def found(spark, field, *texts):
    rows = extraction.extract(lines(spark, *texts)).where(F.col("field") == field).orderBy("line_number", "norm_num").collect()
    return [r.norm_num if r.norm_num is not None else r.raw_value for r in rows]


def test_extraction_of_plain_lines(spark):
    assert found(spark, "abv", "45% ABV", "Alc. 40% by Vol.", "12.5 percent alcohol by volume", "145% ABV", "90 Proof") == [45.0, 40.0, 12.5]
    assert found(spark, "net_contents", "1000mI", "750 mi", "750 mL", "375 mL") == [1000.0, 750.0, 375.0]
    assert found(spark, "net_contents", "1 PINT 0.9 FL OZ (500 ML)") == [500.0]
    assert found(spark, "net_contents", "1 PINT 0.9 FL OZ (750 ML)") == [pytest.approx(499.79265, abs=1e-4), 750.0]
    assert found(spark, "net_contents", "1 Pt. 9.4 FI. Oz") == [] and found(spark, "net_contents", "1 PINT 12") == [pytest.approx(473.176473)]
    assert found(spark, "class_type", "India Pale Ale o®") == ["India Pale Ale"]
    assert found(spark, "brand_name", "OLD TOM DISTILLERY", "Straight Bourbon Whiskey", "45% Alc./Vol.", "750 mL", "Bottled by Old Tom LLC, Louisville, KY") == ["OLD TOM DISTILLERY"]
    assert found(spark, "brand_name", "45% ABV", "Stone's Throw") == ["Stone's Throw"] and found(spark, "brand_name", "GOLDEN STATE") == ["GOLDEN STATE"]
    assert found(spark, "producer_name", "Bottled by: Old Tom LLC, Dallas, TX 75201") == ["Old Tom LLC"]
    assert found(spark, "producer_address", "Bottled by: Old Tom LLC, Dallas, TX 75201") == ["Dallas, TX"]
    assert found(spark, "producer_name", "Distilled and bottled by", "Example Distillery", "Louisville, KY") == ["Example Distillery"]
    assert found(spark, "producer_address", "Distilled and bottled by", "Example Distillery", "Louisville, KY") == ["Louisville, KY"]
    assert found(spark, "country_origin", "Product of France.", "Imported from New Zealand bottled by X", "Made in Italy") == ["France", "New Zealand", "Italy"]


def boxed(spark, *rows):
    kind = "doc_id int, line_number int, text string, left int, top int, width int, height int, panel_id int, line_height double, mean_confidence double, image_height int"
    return spark.createDataFrame([(1, i + 1, t, x, y, w, h, p, float(h), 0.9, 1000) for i, (t, x, y, w, h, p) in enumerate(rows)], kind)


def test_extraction_of_boxed_lines(spark):
    got = extraction.extract(boxed(
        spark, ("NORTH", 100, 50, 200, 60, 0), ("RIVER", 100, 115, 200, 60, 0), ("Hazy Session", 100, 300, 160, 30, 0), ("IPA", 105, 335, 150, 30, 0),
        ("Brewed by North River", 100, 500, 300, 20, 0), ("far from it", 100, 530, 300, 20, 0), ("Portland, OR", 100, 560, 300, 20, 0), ("Salem, OR", 700, 560, 300, 20, 1), ("Aged Rum", 700, 600, 200, 20, 1), ("Dark Rum", 700, 625, 200, 20, 1),
    )).collect()
    by = {f: [(r.raw_value, r.line_number) for r in got if r.field == f] for f in comparison.FIELDS}
    assert by["brand_name"] == [("NORTH RIVER", 1)] and by["producer_address"] == [("Portland, OR", 7)]
    assert sorted(by["class_type"]) == [("Aged Rum Dark Rum", 9), ("Hazy Session", 3), ("IPA", 4)]
    region = spark.createDataFrame([(1, 90, 490, 400, 200)], "doc_id int, left int, top int, width int, height int")
    masked = extraction.extract(boxed(spark, ("NORTH", 100, 50, 200, 60, 0), ("Brewed by North River", 100, 500, 300, 20, 0)), region).collect()
    assert [r.field for r in masked] == ["brand_name"]


def statuses(spark, expected, *texts):
    row = {"doc_id": 1, "brand_name": "Stone's Throw", "class_type": "Red Wine", "abv": 45.0, "net_contents": "750 mL", "producer_name": "Old Tom LLC", "producer_address": "Louisville, KY", "imported_product": True, "country_origin": "France"} | expected
    got = comparison.compare(spark.createDataFrame([row]), extraction.extract(lines(spark, *texts)))
    return {r.field: r.status for r in got.collect()}


def test_comparison(spark):
    assert statuses(spark, {}, "St0ne's Throw")["brand_name"] == "review" and statuses(spark, {}, "River Bend")["brand_name"] == "mismatch" and statuses(spark, {}, "45% ABV")["brand_name"] == "not_found"
    got = statuses(spark, {"net_contents": "0.75 L", "abv": 46.0}, "Stone’s Throw", "45% ABV", "750 mL", "Bottled by Old Tom LLC", "Louisville, TN", "Product of Franee")
    assert got == {"brand_name": "match", "class_type": "not_found", "abv": "mismatch", "net_contents": "match", "producer_name": "match", "producer_address": "mismatch", "country_origin": "review"}
    assert statuses(spark, {"imported_product": False}, "x")["country_origin"] == "not_applicable"
    assert statuses(spark, {}, "Product of Italy")["country_origin"] == "mismatch" and statuses(spark, {}, "45% ABV", "40% ABV")["abv"] == "review"


def warned(spark, text):
    row = warning.localised(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    return row.select(warning.presence(), warning.wording()["status"], warning.capitalisation(), warning.continuity()).first()


def test_warning_text(spark):
    assert tuple(warned(spark, f"Brand\n{WHOLE}\nmore")) == ("match", "match", "match", "review")
    assert warned(spark, WHOLE.replace(" ", "  ").replace(":", "："))[1] == "match"
    assert tuple(warned(spark, "Brand")) == ("not_found",) * 4
    for text, status in [("GOVERNMENT", "review"), ("G0VERNMENT", None), ("beveraqes", "review"), ("(3)", "review")]:
        swap = {"GOVERNMENT": ("risk", "r1sk"), "G0VERNMENT": ("GOVERNMENT", "G0VERNMENT"), "beveraqes": ("beverages", "beveraqes"), "(3)": ("(1)", "(3)")}[text]
        got = warned(spark, WHOLE.replace(*swap, 1))[1]
        assert status is None or got == status, text
    for changed in (WHOLE.replace("should not", "should"), WHOLE.replace("birth defects", "hangovers"), WHOLE.replace(CLAUSES[1], "")):
        assert warned(spark, changed)[1] == "mismatch"
    assert warned(spark, WHOLE.replace(HEADING, "Government Warning"))[2] == "mismatch" and warned(spark, "x " + CLAUSES[0])[0] == "review"
    assert warned(spark, f"{HEADING}: {CLAUSES[1]} {CLAUSES[0]}")[3] == "mismatch" and warned(spark, WHOLE.replace("(2)", "buy fresh lemons (2)"))[3] == "mismatch"


def test_warning_among_boxes(spark):
    rows = [("BRAND", 100, 50, 300, 40, 0), (HEADING + ": (1) According to the Surgeon", 100, 500, 400, 20, 0), ("OTHER COLUMN", 900, 505, 100, 20, 0), ("General, women and may cause health problems.", 100, 525, 400, 20, 0), ("below", 100, 550, 400, 20, 0)]
    got = warning.grown(boxed(spark, *rows)).first()
    assert (got.panel_id, got.line_numbers, got.heading, got.distinctive) == (0, [2, 4], True, True)
    box = "struct<left:double,top:double,width:double,height:double>"

    def status(*boxes):
        data = spark.createDataFrame([([tuple(map(float, b)) for b in boxes],)], f"b array<{box}>")
        return data.select(warning.geometry(warning.rows_of(F.col("b")))).first()[0]

    assert status((0, 0, 50, 10), (55, 1, 50, 10), (0, 14, 90, 10)) == "match"
    assert status((0, 0, 50, 10), (155, 1, 50, 10)) == "review" and status((0, 0, 50, 10), (0, 60, 50, 10)) == "review" and status((0, 0, 50, 10), (80, 12, 50, 10)) == "review"
    gaps = spark.createDataFrame([(30.0, 20.0), (4.0, 20.0), (None, 20.0), (3.0, None)], "d double, h double")
    assert [r[0] for r in gaps.select(warning.separation(F.col("d"), F.col("h"))).collect()] == ["match", "review", "match", "review"]


def test_warning_statuses(spark):
    for check in warning.CHECKS:
        for status in ("review", "mismatch"):
            rows = spark.createDataFrame([(1, c, status if c == check else "match") for c in warning.CHECKS], "doc_id int, check string, status string")
            got = warning.statuses(rows).first()
            physical = check in warning.PHYSICAL
            assert got.automated_status == ("match" if physical and status == "review" else status) and got.manual_confirmation_required == physical


def test_manifest_file(spark, tmp_path):
    head = ",".join(manifest.COLUMNS)
    (tmp_path / "a.csv").write_bytes(("\ufeff" + head + '\r\n"a ""b"".png","X, Y",Gin,45,750 mL,P,"L, KY",false,\r\n\r\nb.png,B,Gin,101,bad,P,A,true,\r\n').encode())
    rows = manifest.errors_of(manifest.read_manifest(spark, str(tmp_path / "a.csv"))).orderBy("row_number").collect()
    assert [(r.row_number, r.image_filename, r.brand_name, len(r.errors)) for r in rows] == [(2, 'a "b".png', "X, Y", 0), (3, "b.png", "B", 3)]
    (tmp_path / "b.csv").write_text("image_filename,brand_name\na,b\n")
    (tmp_path / "c.csv").write_text(head + "\n" + "a,b,c,45,750 mL,p,q,false,\n" * 301)
    for name in ("b.csv", "c.csv"):
        with pytest.raises(manifest.ManifestError):
            manifest.read_manifest(spark, str(tmp_path / name))
    files = spark.createDataFrame([("ONE.JPG",), ("one.jpg",), ("two.png",), ("extra.png",)], "name string")
    keyed = manifest.flag_duplicates(spark.createDataFrame([("one.jpg",), ("x\\TWO.png",), ("gone.png",)], "image_filename string"))
    mapped, unmatched = manifest.map_files(keyed, files)
    assert sorted((r.file_key, r.file_status) for r in mapped.collect()) == [("gone.png", "missing"), ("one.jpg", "multiple"), ("two.png", "ready")] and [r.name for r in unmatched.collect()] == ["extra.png"]


def test_word_files(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "w.tsv").write_text(head + "1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t10\t10\t20\t8\t91.5\tOLD\n5\t1\t1\t1\t1\t2\t35\t10\t20\t8\t-1\t\"TOM\n5\t1\t1\t1\t2\t1\t10\t30\t20\t8\t80\tGIN\n")
    words = manifest.read_words(spark, str(tmp_path / "w.tsv"))
    assert [(r.text, r.confidence) for r in words.orderBy("ordinal").collect()] == [("OLD", 0.915), ('"TOM', None), ("GIN", 0.8)]
    assert manifest.raw_text(words).first().text == 'OLD "TOM\nGIN'
    (tmp_path / "v.tsv").write_text("level\tconf\n5\t1\n")
    with pytest.raises(manifest.WordsError):
        manifest.read_words(spark, str(tmp_path / "v.tsv"))
    with pytest.raises(manifest.WordsError, match="v.tsv"):
        manifest.read_words(spark, str(tmp_path))
    (tmp_path / "v.tsv").write_text("")
    assert manifest.read_words(spark, str(tmp_path)).count() == 3


def test_records_images_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    full = {"class_type": "Gin", "abv": "45", "net_contents": "1 L", "producer_name": "P", "producer_address": "A"}
    for name, row in {"T01.json": {**full, "brand": "B", "imported": False, "country_origin": "France"}, "ABC.json": {**full, "brand_name": "C", "imported_product": "true"}, "part.json": {"brand": None, "imported": True, "class_type": "Gin", "country_of_origin": "Chile"}}.items():
        (tmp_path / "in" / name).write_text(json.dumps(row))
    got = {r.path.rsplit("/", 1)[1]: r for r in records.read_records(spark, str(tmp_path / "in" / "*.json")).collect()}
    assert (got["T01.json"].brand_name, got["T01.json"].abv, got["T01.json"].imported_product, got["T01.json"].error) == ("B", 45.0, False, None) and got["T01.json"].country_origin is None
    assert got["ABC.json"].errors == ["imported_product must be true or false"] and got["ABC.json"].imported_product is None
    assert got["part.json"].errors == [f"{f} is missing" for f in records.REQUIRED if f != "class_type"] and got["part.json"].country_origin == "Chile"
    image, huge = png(640, 480), png(13000, 10)
    pictures = {"cut.png": image[:-6], "moves.png": png(9, 9, chunk(b"acTL", struct.pack(">II", 3, 0))), "a.jpeg": jpeg(300, 200), "cut.jpg": jpeg(300, 200)[:-2], "a.webp": webp(320, 240), "moves.webp": webp(32, 24, 2), "cut.webp": webp(320, 240)[:-3], "wide.jpg": jpeg(13000, 2)}
    for name, data in {"T01_x.png": image, "ABC.jpg": image, "far.png": huge, "n.txt": b"x", **pictures}.items():
        (tmp_path / "in" / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in records.read_images(spark, str(tmp_path / "in")).collect()}
    read = {k: r.error for k, r in rows.items()}
    assert {k: (r.width, r.height) for k, r in rows.items() if r.error is None} == {"T01_x.png": (640, 480), "a.jpeg": (300, 200), "a.webp": (320, 240)}
    assert read["cut.png"] == read["cut.jpg"] == read["cut.webp"] == "not a readable image" and read["moves.png"] == read["moves.webp"] == "animated images are not supported" and "side" in read["wide.jpg"]
    assert read["T01_x.png"] is None and "declared" in read["ABC.jpg"] and "side" in read["far.png"] and "not a PNG" in read["n.txt"]
    images = spark.createDataFrame([("d/T01_x.png",), ("d/ABC.jpg",), ("d/none.png",)], "path string")
    jsons = spark.createDataFrame([("d/T01.json",), ("d/ABC.json",)], "path string")
    assert [tuple(r) for r in records.paired(images, jsons).collect()] == [("d/ABC.jpg", "d/ABC.json"), ("d/T01_x.png", "d/T01.json")]
    assert one(spark, records.media_type, "image/png; x", "IMAGE/JPEG", "text/html") == ["image/png", "image/jpeg", None]
    items = spark.createDataFrame([(1, 2, "a.png", "=DANGEROUS(), LLC", "match", 12.6, ""), (2, 3, "b.png", "B", "invalid", None, "abv")], "doc_id int, row_number int, image_filename string, brand_name string, status string, duration_ms double, error string")
    results = spark.createDataFrame([(1, f, "match") for f in comparison.FIELDS], "doc_id int, field string, status string")
    warned = spark.createDataFrame([(1, "review", "match", True)], "doc_id int, overall_status string, automated_status string, manual_confirmation_required boolean")
    manifest.write_results(records.results_table(items, results, warned).coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes().decode()
    assert text.split("\r\n")[0] == ",".join(records.RESULT_COLUMNS) and len(records.RESULT_COLUMNS) == 15
    assert text.split("\r\n")[1].startswith('a.png,"\'=DANGEROUS(), LLC",match,match') and ",validation_error," in text.split("\r\n")[2]
    records.write_template(spark, str(tmp_path / "template"))
    assert manifest.read_manifest(spark, str(tmp_path / "template")).first().brand_name == "Stone's Throw"
    whole = comparison.overall(results)
    assert json.loads(records.responses(results.select("*", *(F.lit(None).cast("string").alias(c) for c in ("expected_raw", "extracted_raw", "similarity_score", "evidence"))), whole).first().response)["overall_status"] == "match"


def test_words_to_lines(spark):
    rows = [(1, 1, 1, 1, 1, k, x, 10, 30, 10, 0.9, t, 1000) for k, (x, t) in enumerate([(0, "a"), (40, "b"), (400, "c")])]
    words = spark.createDataFrame(rows, "doc_id int, page int, block int, paragraph int, line int, ordinal int, left int, top int, width int, height int, confidence double, text string, image_width int")
    got = sorted((r.left, r.text) for r in layout.lines_from(layout.split_lines(words)).collect())
    assert got == [(0, "a b"), (400, "c")]
    loose = spark.createDataFrame([(1, None, None, None, None, k, 0, 10 * k, 30, 10, 0.9, t, 1000) for k, t in enumerate("xyz")], words.schema)
    assert sorted(r.text for r in layout.lines_from(layout.split_lines(words.unionByName(loose))).collect()) == ["a b", "c", "x", "y", "z"]
    region = spark.createDataFrame([(1, 0)], "doc_id int, ordinal int")
    assert layout.nearest_other(words, region).first().distance == 10.0


def test_queue(spark, tmp_path):
    items = spark.createDataFrame([(str(i), str(i)) for i in range(30)], "item_id string, payload string")

    def work(payload):
        return str(10 // (int(payload) - 3))

    got = {r.item_id: r.status for r in streaming.settle(items, work).collect()}
    assert got["3"] == "rejected" and sum(s == "fulfilled" for s in got.values()) == 29
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    streaming.start(stream, work, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'rejected'").first().error == "ZeroDivisionError"
    states = spark.createDataFrame([("a", 1, "ready"), ("a", 2, "error"), ("b", 1, "ready"), ("c", 1, "match")], "item_id string, at int, status string")
    assert [r.item_id for r in streaming.to_run(states).collect()] == ["b"] and [r.item_id for r in streaming.to_run(states, retry=True).collect()] == ["a"]


def test_weight_and_contrast(spark):
    """Bars of two and of four pixels on white: the second is the heavier one; faint bars say nothing."""

    def bars(crop, width, dark):
        return [(crop, x, y, dark if 4 <= x < 4 + width else 255) for y in range(16) for x in range(16)]

    rows = [p for k in range(3) for p in bars(f"h{k}", 4, 0)] + [p for k in range(3) for p in bars(f"b{k}", 2, 0)] + bars("f0", 4, 220)
    crops = spark.createDataFrame(rows, "crop string, x int, y int, level int")
    named = spark.createDataFrame([(c, 1, c[0] == "h", 16, 16) for c in ("h0", "h1", "h2", "b0", "b1", "b2", "f0")], "crop string, doc_id int, heading boolean, width int, height int")
    by = {r.heading: r for r in pixels.weights(crops, named).collect()}
    assert by[True].stroke == 2 * 64 / 40 and by[False].stroke == 2 * 32 / 36
    both = spark.createDataFrame([((3.2, 16.0), (1.8, 16.0)), ((1.0, 16.0), (1.8, 16.0)), ((1.8, 16.0), (1.8, 16.0)), ((3.2, 8.0), (1.8, 16.0))], "h struct<stroke:double,height:double>, b struct<stroke:double,height:double>")
    assert [r[0] for r in both.select(pixels.weight_status(F.col("h"), F.col("b"))).collect()] == ["match", "mismatch", "review", "review"]
    tone = pixels.tones(crops.where("crop = 'h0'")).first()
    assert (tone.contrast, tone.background_std) == (1.0, 0.0)
    cases = [(0.1, 5.0, 900, 0.9, 9, 0.9, 5), (0.5, 5.0, 900, 0.7, 9, 0.5, 90), (0.5, 50.0, 900, 0.9, 9, 0.6, 10), (0.5, 50.0, 900, 0.8, 9, 0.6, 10), (0.5, 5.0, 400, 0.9, 9, 0.6, 10), (0.5, 5.0, 900, 0.9, 3, 0.6, 10)]
    data = spark.createDataFrame(cases, "a double, b double, c int, d double, e int, f double, g int")
    assert [r[0] for r in data.select(pixels.contrast_status(*(F.col(c) for c in "abcdefg"))).collect()] == ["mismatch", "match", "match", "review", "review", "review"]
    strips = spark.createDataFrame([(c, side, x, 0, 250) for c in ("h0", "h1") for side in (0, 1) for x in range(9)], "crop string, side int, x int, y int, level int")
    word = pixels.word_tones(crops, strips, named).first()
    assert (word.n_words, word.lower_contrast, word.upper_spread) == (2, 1.0, 0)


def test_alignment_and_changes(spark):
    """Opcodes of the words, what each change looks like, and words that do not belong."""
    texts = [WHOLE, WHOLE.replace("risk", "r1sk"), WHOLE.replace("drink alcoholic", "drink alco holic"), WHOLE.replace("of the risk of birth", "x y z u v"), WHOLE.replace("should not", "should"), WHOLE.replace("(2)", "fresh beverageS lemons (2)"), WHOLE.replace("women", "wornen")]
    rows = warning.localised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).select("doc_id", "opcodes", "changes", "words", warning.strange_words().alias("strange"), warning.wording().alias("w")).orderBy("doc_id").collect()
    words = warning._EXPECTED
    for r in rows:
        assert [(o.a, o.b) for o in r.opcodes][0][0] == 0 and r.opcodes[-1].b == len(words) and all(x.b == y.a and x.d == y.c for x, y in zip(r.opcodes, r.opcodes[1:]))
        assert all(words[o.a : o.b] == r.words[o.c : o.d] for o in r.opcodes if o.kind == "equal")
    assert [[(c.kind, c.misread, c.rejoined, c.long) for c in r.changes] for r in rows[:3]] == [[], [("replace", True, False, False)], [("replace", False, True, False)]]
    assert any(c.long for c in rows[3].changes) and [(c.kind, c.want) for c in rows[4].changes] == [("delete", ["not"])]
    assert [rows[5].words[k] for k in rows[5].strange] == ["fresh", "lemons"]
    assert [r.w.status for r in rows] == ["match", "review", "review", "mismatch", "mismatch", "mismatch", "mismatch"]
    assert rows[0].w.token_similarity is None and rows[4].w.token_similarity == round(2 * (len(words) - 1) / (2 * len(words) - 1), 3)
