"""Candidates from label lines: one long table over (doc_id, field), in one pass over the lines.

Lines are (doc_id, line_number, text), with or without boxes (left, top, width, height, panel_id, line_height,
mean_confidence, image_height). All rules that look at neighbours are windows over doc_id, so lines are
shuffled once; each line then yields an array of candidates of all fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docproof.functions import text as T

#: Patterns of label statements.
_NUMBER = r"\d{1,3}(?:\.\d+)?"
ABV = [rf"(?iU)({_NUMBER})\s*%\s*(?:a\.?\s*b\.?\s*v\.?|alc(?:ohol)?\.?\s*(?:/|by)?\s*vol(?:ume)?\.?)", rf"(?iU)alc(?:ohol)?\.?\s*({_NUMBER})\s*%\s*(?:by\s*)?vol(?:ume)?", rf"(?iU)({_NUMBER})\s+percent\s+alcohol\s+by\s+volume"]
_METRIC = r"(ml|(?-i:mI)|millilit(?:er|re)s?|l|lit(?:er|re)s?)"
VOLUME = r"(?iU)(?<![\w.])(\d+(?:\.\d+)?)\s*(ml|(?-i:mI)|millilit(?:er|re)s?|l|lit(?:er|re)s?|pints?|pt|fl\.?\s*oz\.?|fluid\s+ounces?)(?!\w)"
COMPOUND = rf"(?iU)(?<![\w.])(\d+(?:\.\d+)?)\s*(?:pints?|pt)\s+(\d+(?:\.\d+)?)\s*(?:fl\.?\s*oz\.?|fluid\s+ounces?)\s*\(\s*(\d+(?:\.\d+)?)\s*{_METRIC}\s*\)"
CLASS = r"(?iuU)\b(?:whisk(?:e)?y|bourbon|vodka|gin|rum|tequila|mezcal|brandy|ale|lager|beer|stout|porter|cider|wine|sauvignon|chardonnay|merlot|riesling|ros[ée]|liqueur|cordial)\b"
ACRONYM = r"(?iU)\bipa\b"
NOT_BRAND = (
    r"(?iU)\b(?:government\s+warning|alcohol\s+by\s+volume|alc\.?\s*/?\s*vol|contains\s+sulfites|bottled\s+by|produced\s+by|distilled\s+by|brewed\s+by|vinted\s+by|cellared\s+by|imported\s+by|imported\s+from|"
    r"product\s+of|produced\s+in|made\s+in|proof|net\s+contents?|according\s+to\s+the\s+surgeon|surgeon\s+general|during\s+pregnancy|risk\s+of\s+birth\s+defects|birth\s+defects|alcoholic\s+beverages|"
    r"consumption\s+of\s+alcoholic\s+beverages|ability\s+to\s+drive|operate\s+machinery|may\s+cause\s+health\s+problems)\b"
)
GENERIC = ("premium", "handcrafted", "small batch", "reserve", "established")
PRODUCER = r"(?iU)\b(?:(?:produced|distilled)\s+and\s+bottled|bottled|produced|distilled|brewed|vinted|cellared|imported)\s+by\b[\s,:-]*(.*)$"
ORIGIN = r"(?iU)\b(?:product\s+of|produced\s+in|imported\s+from|made\s+in)\s+([A-Za-z][A-Za-z '-]{1,60}?)(?=\s*(?:[.,;:]|(?:imported|bottled|produced)\s+by\b|$))"
TORN_PINT = rf"(?iU)(?<![\w.])\d+(?:\.\d+)?\s*(?:pints?|pt)\.?\s+\d+(?:\.\d+)?\s+\S"
_NAMES, _CODES = "|".join(sorted(T.STATES, key=len, reverse=True)), "|".join(sorted(set(T.STATES.values())))
INLINE_ADDRESS = rf"(?iU)\A(.+?),\s*([A-Za-z .'-]+),\s*({_NAMES}|{_CODES}|state)(?:\s+\d{{5}}(?:-\d{{4}})?)?\s*\z"
#: Only looked for, so one letter before a state tells as much as all of them, in time linear in a line's length.
ADDRESS = (
    r"(?iU)\b\d{5}(?:-\d{4})?\s*\z|\b(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|highway|hwy\.?|p\.?\s*o\.?\s*box)\b|"
    rf"[A-Za-z .'-](?:,\s*|\.\s+|\s+)(?:{_CODES})(?:\s+\d{{5}})?\s*\z|[A-Za-z .'-](?:,\s*|\.\s+|\s+)(?:{_NAMES})\s*\z|[A-Za-z .'-],\s*STATE\s*\z"
)
#: Columns of a line that may be missing.
BOX = {"left": "double", "top": "double", "width": "double", "height": "double", "panel_id": "int", "line_height": "double", "mean_confidence": "double", "image_height": "double"}
CANDIDATE = "array<struct<field:string,raw_value:string,norm_num:double,source_line:string,line_number:int,score:double,boxed:boolean>>"


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbered lines, white space collapsed; numbers count blank lines, which are then dropped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\R")).alias("at", "line"))
    clean = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    return rows.select("doc_id", (F.col("at") + 1).alias("line_number"), clean.alias("text")).where("text <> ''")


def _stripped(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, rf"\A[{marks}]+|[{marks}]+\z", "")


def candidate(field: str, raw: Column, source: Column, number: Column, num: Column | None = None, score: Column | None = None, boxed: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(field).alias("field"), raw.alias("raw_value"), (none if num is None else num).cast("double").alias("norm_num"), source.alias("source_line"),
        number.cast("int").alias("line_number"), (none if score is None else score).cast("double").alias("score"), (F.lit(False) if boxed is None else boxed).alias("boxed"),
    )


def _if(condition: Column, *candidates: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*candidates)).otherwise(F.array()).cast(CANDIDATE)


def abv_of(text: Column, number: Column) -> Column:
    """Every stated percentage of alcohol over 0 and at most 100; text without a sign or word for one is not searched."""
    found = []
    for p in ABV:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), 0).alias("whole"), F.regexp_extract_all(text, F.lit(p), 1).alias("value"))
        fit = F.filter(pairs, lambda m: (m.value.cast("double") > 0) & (m.value.cast("double") <= 100))
        found.append(F.transform(fit, lambda m: candidate("abv", _stripped(m.whole, " ,;"), text, number, m.value.cast("double"))))
    return F.when(~text.rlike(r"%|(?i)percent"), F.array().cast(CANDIDATE)).otherwise(F.concat(*found).cast(CANDIDATE))


def volumes_of(text: Column, number: Column) -> Column:
    """Stated volumes; pints, ounces and millilitres of one statement that agree within 1 ml or 1 % are one value.

    A lone pint with another number and more text behind it is half a statement and counts for nothing. Every statement
    has a plain volume in it, so text without one is not searched further.
    """
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(COMPOUND), k).alias(f"g{k}") for k in range(5)))
    whole = F.filter(parts, lambda m: m.g3.cast("double") > 0)

    def both(m: Column) -> Column:
        custom, metric = T.millilitres(m.g1, F.lit("pint")) + T.millilitres(m.g2, F.lit("fl oz")), T.millilitres(m.g3, m.g4)
        agree = F.abs(custom - metric) <= F.greatest(F.lit(1.0), metric * 0.01)
        one = candidate("net_contents", F.trim(m.g0), text, number, metric)
        two = [candidate("net_contents", F.concat(m.g1, F.lit(" PINT "), m.g2, F.lit(" FL OZ")), text, number, custom), candidate("net_contents", F.concat_ws(" ", m.g3, m.g4), text, number, metric)]
        return F.when(agree, F.array(one)).otherwise(F.array(*two))

    rest = F.when(F.size(whole) > 0, F.regexp_replace(text, COMPOUND, " ")).otherwise(text)
    single = F.arrays_zip(*(F.regexp_extract_all(rest, F.lit(VOLUME), k).alias(f"g{k}") for k in range(3)))
    single = F.filter(single, lambda m: m.g1.cast("double") > 0)
    each = F.transform(single, lambda m: candidate("net_contents", F.trim(m.g0), text, number, T.millilitres(m.g1, m.g2)))
    torn = (F.size(F.regexp_extract_all(text, F.lit(VOLUME), 0)) == 1) & text.rlike(TORN_PINT)
    return F.when(~text.rlike(VOLUME) | torn, F.array()).otherwise(F.concat(F.flatten(F.transform(whole, both)), each)).cast(CANDIDATE)


def countries_of(text: Column, number: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(ORIGIN), 1), lambda c: _stripped(c, " .,:;-"))
    return F.transform(F.filter(found, lambda c: c != ""), lambda c: candidate("country_origin", c, text, number)).cast(CANDIDATE)


def abv_candidates(lines: DataFrame) -> DataFrame:
    return _exploded(lines.select("doc_id", abv_of(F.col("text"), F.col("line_number")).alias("c")))


def volume_candidates(lines: DataFrame) -> DataFrame:
    return _exploded(lines.select("doc_id", volumes_of(F.col("text"), F.col("line_number")).alias("c")))


def country_candidates(lines: DataFrame) -> DataFrame:
    return _exploded(lines.select("doc_id", countries_of(F.col("text"), F.col("line_number")).alias("c")))


def class_candidates(lines: DataFrame) -> DataFrame:
    return extract(lines).where("field = 'class_type'")


def brand_candidates(lines: DataFrame) -> DataFrame:
    return extract(lines).where("field = 'brand_name'")


def producer_candidates(lines: DataFrame) -> DataFrame:
    return extract(lines).where(F.col("field").isin("producer_name", "producer_address"))


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def _neighbours(a: Column, b: Column, above: float, below: float, aside: Column, share: float, height: Column) -> Column:
    """Whether line b stands under line a in its panel, with a gap of -above to below heights and ``aside`` within a share of the width."""
    gap = b.top - (a.top + a.height)
    fit = a.panel_id.eqNullSafe(b.panel_id) & (gap >= -above * height) & (gap <= below * height) & (aside <= share * F.greatest(a.width, b.width))
    return F.coalesce(fit, F.lit(False))


def class_neighbours(a: Column, b: Column) -> Column:
    height = F.greatest(F.coalesce(a.line_height, a.height), F.coalesce(b.line_height, b.height))
    return _neighbours(a, b, 0.5, 1.5, F.abs(a.left - b.left), 0.35, height)


def brand_neighbours(a: Column, b: Column) -> Column:
    aside = F.abs((a.left + a.width / 2) - (b.left + b.width / 2))
    return _neighbours(a, b, 0.25, 1.2, aside, 0.4, F.greatest(a.height, b.height)) & F.concat(a.text, b.text).rlike(r"(?U)\p{L}")


def _brand_score(line: Column, key: Column, producers: Column, typical: Column) -> Column:
    words, relative = F.size(F.split(key, " ")), line.top / line.image_height
    partly = F.exists(producers, lambda p: p.contains(key) | F.contains(key, p))
    return (
        F.greatest(F.lit(0.0), 1.2 - line.line_number * 0.05)
        + F.when(words <= 5, 0.5).otherwise(0.0)
        + F.when(F.array_contains(producers, key), 2.0).when(partly, 0.8).otherwise(0.0)
        + F.coalesce(F.least(F.lit(2.5), line.line_height / F.greatest(typical, F.lit(1.0))), F.lit(0.0))
        + F.when(relative <= 0.35, 0.8).when(relative > 0.7, -0.6).otherwise(0.0)
        + F.coalesce(line.mean_confidence * 0.4, F.lit(0.0))
    )


def _judged(lines: DataFrame) -> DataFrame:
    """The lines with what the rules ask of them and of their neighbours."""
    names = lines.columns
    full = lines.select("doc_id", "line_number", "text", *(F.col(c).cast(k).alias(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in BOX.items()))
    t = F.col("text")
    barred, klass, acronym, cue = t.rlike(NOT_BRAND), t.rlike(CLASS), t.rlike(ACRONYM), t.rlike(PRODUCER)
    other = _any(t, [ORIGIN, ADDRESS, VOLUME, *ABV])
    tail = _stripped(F.regexp_extract("text", PRODUCER, 1), " ,:-")
    bare = ~barred & ~klass & ~cue & ~other
    line = F.struct(
        "line_number", "text", *BOX, ((klass | acronym) & ~barred).alias("is_class"), acronym.alias("acronym"), F.when(cue, tail).alias("tail"), t.rlike(ADDRESS).alias("address"),
        (bare & t.rlike(r"(?U)\p{L}") & (F.length(t) <= 100)).alias("brand"), (bare & ~acronym & (F.length(t) <= 60) & t.rlike(r"(?U)\p{L}|\d{2}")).alias("joins"),
    )
    by_line = Window.partitionBy("doc_id").orderBy("line_number")
    around = full.select("doc_id", line.alias("l"), "line_number").select("doc_id", "line_number", "l", *(F.lead("l", k).over(by_line).alias(n) for k, n in ((1, "n1"), (2, "n2"), (3, "n3"))), F.lag("l").over(by_line).alias("p1"))
    p1, l, n1 = F.col("p1"), F.col("l"), F.col("n1")
    takes = (l.tail == "") & n1.text.isNotNull() & ~F.coalesce(n1.address, F.lit(False))
    inline = l.tail.rlike(INLINE_ADDRESS)
    name = F.when(inline, _stripped(F.regexp_extract(l.tail, INLINE_ADDRESS, 1), " ,:-")).when(l.tail != "", l.tail).when(takes, n1.text)
    joined = F.when(l.joins & n1.joins & n1.text.rlike(r"(?U)\p{L}") & brand_neighbours(l, n1), F.concat_ws(" ", l.text, n1.text))
    begins = l.is_class & ~(F.coalesce(p1.is_class, F.lit(False)) & class_neighbours(p1, l))
    return around.select(
        "*", takes.alias("takes"), inline.alias("inline"), name.alias("name"), joined.alias("joined"), begins.alias("begins"), T.all_folded(F.array(l.text, name, joined)).alias("folds"),
        F.coalesce(n1.acronym & class_neighbours(l, n1), F.lit(False)).alias("inferred"), F.coalesce(n1.acronym & class_neighbours(l, n1) & n1.is_class & ~l.is_class, F.lit(False)).alias("promotes"),
    )


def _addresses(l: Column, n1: Column, n2: Column, n3: Column, takes: Column, boxed: Column) -> Column:
    """Address lines behind a producer's cue: on plain text the first of the next two lines, else the nearest ones in the panel, with those hardly farther away."""
    one, two = F.when(takes, n2).otherwise(n1), F.when(takes, n3).otherwise(n2)
    plain = F.array_compact(F.array(F.when(one.address, F.struct(one.text.alias("text"), one.line_number.alias("line_number"))).when(two.address, F.struct(two.text.alias("text"), two.line_number.alias("line_number")))))
    height = F.coalesce(l.line_height, l.height)
    first = l.line_number + F.when(takes, 2).otherwise(1)

    def gap(b: Column) -> Column:
        return b.top - (l.top + l.height)

    near = F.filter(boxed, lambda b: (b.line_number >= first) & b.panel_id.eqNullSafe(l.panel_id) & (gap(b) >= -l.height) & (gap(b) <= F.greatest(height * 7, F.coalesce(l.image_height, F.lit(0.0)) * 0.12)))
    least = F.array_min(F.transform(near, lambda b: F.abs(gap(b))))
    close = F.filter(near, lambda b: F.abs(gap(b)) <= least + F.greatest(height, F.lit(20.0)) * 2)
    ordered = F.transform(F.array_sort(F.transform(close, lambda b: F.struct(F.abs(gap(b)).alias("d"), b.line_number.alias("line_number"), b.text.alias("text")))), lambda b: F.struct(b.text.alias("text"), b.line_number.alias("line_number")))
    return F.when(l.top.isNull(), plain).otherwise(ordered)


def _exploded(rows: DataFrame) -> DataFrame:
    """(doc_id, field, raw_value, norm_text, norm_num, source_line, line_number, score, boxed, ordinal) from rows(doc_id, c).

    Exploded as outer and filtered behind it: before an inner one the optimizer asks for the size of c, and so finds all candidates twice.
    """
    each = rows.select("doc_id", F.posexplode_outer("c").alias("ordinal", "c")).where("c is not null").select("doc_id", "ordinal", "c.*")
    key = T.text_key(F.col("raw_value"))
    field = F.col("field")
    norm = F.when(field.isin("abv", "net_contents"), None).when(field == "producer_address", T.state_codes(key)).when(field == "country_origin", T.country_of_key(key)).otherwise(key)
    return each.select("doc_id", "field", "raw_value", norm.alias("norm_text"), "norm_num", "source_line", "line_number", "score", "boxed", "ordinal")


def extract(lines: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """All candidates; lines of ``excluded`` (doc_id, line_number) take no part, nor lines that overlap its boxes (doc_id, left, top, width, height). Expected values are not an input."""
    if excluded is not None and "line_number" in excluded.columns:
        lines = lines.join(excluded, ["doc_id", "line_number"], "left_anti")
    elif excluded is not None:
        region, own = F.struct("left", "top", "width", "height"), F.struct(*(lines[c] for c in ("left", "top", "width", "height")))
        regions = excluded.select(F.col("doc_id").alias("_doc"), region.alias("_region"))
        lines = lines.join(regions, (F.col("_doc") == lines["doc_id"]) & T.overlaps(own, F.col("_region")), "left_anti")
    doc, panel = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "l.panel_id")
    l, n1, n2, n3, key, number = F.col("l"), F.col("n1"), F.col("n2"), F.col("n3"), T.key_of_folded, F.col("line_number")
    run = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_number"))
    judged = _judged(lines).withColumns({"key": key(F.col("folds")[0]), "joined_key": key(F.col("folds")[2]), "run": run})
    of_doc = judged.select(
        "*",
        F.collect_set(F.when(F.col("name").isNotNull(), key(F.col("folds")[1]))).over(doc).alias("producers"),
        F.collect_list(F.when(l.address & l.top.isNotNull(), l)).over(doc).alias("boxed_addresses"),
        F.collect_set(F.when(F.col("name").isNotNull(), F.when(F.col("takes"), n1.line_number).otherwise(number))).over(doc).alias("taken"),
        F.percentile("l.line_height", 0.5).over(panel).alias("typical"),
        F.array_sort(F.collect_list(F.when(l.is_class, F.struct("line_number", "l.text"))).over(Window.partitionBy("doc_id", "run"))).alias("members"),
        F.lag("inferred").over(Window.partitionBy("doc_id").orderBy("line_number")).alias("after_inferred"),
    )
    text, boxed = l.text, l.top.isNotNull()
    promoted = F.col("promotes") & F.size(F.split("key", " ")).between(2, 7) & (F.length(text) <= 100)
    whole = F.trim(T.without_trailing_mark(F.array_join(F.col("members.text"), " ")))
    free = ~F.array_contains("taken", number)
    brand = l.brand & free & ~F.col("inferred") & (F.col("key") != "") & ~F.col("key").isin(*GENERIC)
    pair = F.col("joined").isNotNull() & ~_any(F.col("joined"), [NOT_BRAND, CLASS, PRODUCER, ORIGIN, ADDRESS, VOLUME, *ABV]) & (F.length("joined") <= 100) & free & ~F.col("inferred") & ~F.coalesce(n1.acronym, F.lit(False)) & ~F.col("joined_key").isin(*GENERIC)
    pair_line = F.struct(number.alias("line_number"), l.top.alias("top"), l.image_height.alias("image_height"), ((l.line_height + n1.line_height) / 2).alias("line_height"), ((l.mean_confidence + n1.mean_confidence) / 2).alias("mean_confidence"))
    city = F.concat_ws(", ", F.trim(F.regexp_extract(l.tail, INLINE_ADDRESS, 2)), F.regexp_extract(l.tail, INLINE_ADDRESS, 3))
    source = F.when(F.col("takes"), F.concat_ws("\n", text, n1.text)).otherwise(text)
    nearby = F.transform(_addresses(l, n1, n2, n3, F.col("takes"), F.col("boxed_addresses")), lambda a: candidate("producer_address", a.text, a.text, a.line_number))
    found = of_doc.select(
        "doc_id",
        F.concat(
            _if(brand, candidate("brand_name", text, text, number, score=_brand_score(l, F.col("key"), F.col("producers"), F.col("typical")), boxed=boxed)),
            _if(pair, candidate("brand_name", F.col("joined"), F.col("joined"), number, score=_brand_score(pair_line, F.col("joined_key"), F.col("producers"), F.col("typical")) + 0.75, boxed=boxed)),
            _if(promoted, candidate("class_type", text, F.concat_ws("\n", text, n1.text), number)),
            _if(F.col("begins") & (whole != ""), candidate("class_type", whole, F.array_join(F.col("members.text"), "\n"), number)),
            abv_of(text, number), volumes_of(text, number),
            _if(F.col("name") != "", candidate("producer_name", F.col("name"), source, F.when(F.col("takes"), n1.line_number).otherwise(number))),
            _if(F.col("inline"), candidate("producer_address", city, text, number)),
            F.when(l.tail.isNotNull(), nearby).otherwise(F.array()).cast(CANDIDATE),
            countries_of(text, number),
        ).alias("c"),
    )
    return best_brands(first_of_each(_exploded(found)))


def first_of_each(candidates: DataFrame) -> DataFrame:
    """Of names and addresses one for each value of a line, the first."""
    same = Window.partitionBy("doc_id", "field", "norm_text", "line_number").orderBy("ordinal")
    once = F.col("field").isin("producer_name", "producer_address")
    return candidates.withColumn("_r", F.when(once, F.row_number().over(same)).otherwise(1)).where("_r = 1").drop("_r")


def best_brands(candidates: DataFrame, most: int = 3, within: float = 0.35) -> DataFrame:
    """The brands of the highest scores; where any has a box, only those within a distance of the best. Adds place, a candidate's order within its field."""
    brand, doc = F.col("field") == "brand_name", Window.partitionBy("doc_id", "field")
    ranked = candidates.select("*", F.row_number().over(doc.orderBy(F.desc("score"), "line_number", "ordinal")).alias("place"), F.max("score").over(doc).alias("_best"), F.bool_or("boxed").over(doc).alias("_boxed"))
    return ranked.where(~brand | ((F.col("place") <= most) & (~F.col("_boxed") | (F.col("score") >= F.col("_best") - within)))).drop("_best", "_boxed", "score", "boxed", "ordinal")
