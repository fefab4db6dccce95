"""Registered queries over the given tables, and the DuckDB SQL that each equals."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.functions import text as T
from docproof.operators import comparison, evaluation, extraction, layout, pixels, refinement, warning
from docproof.plans.label_data import BRAND_TOP, CLAUSES, EXCLUDED, FINER, FINER_CONFIDENCE, HEADING, LETTER, LINES, PRINTED, ROW_APART, SMUDGED, WARNING_BOXES, WORD_CONFIDENCE, applications, excluded_regions, for_duckdb, label_lines, label_words, lines_of_applications, warning_texts, warning_words
from docproof.plans import cases as generated
from docproof.plans.stages import cut
from docproof.sources import crops, manifest, reading, response

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = applications(spark, sf_dir)
    return comparison.compare(apps, extraction.extract(lines_of_applications(apps)))


def _ratio(a: str, b: str) -> float:
    words = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return round(max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, *words).ratio()), 3)


_COUNTRY_SCORE = "case country_origin " + " ".join(f"when '{r}' then {_ratio(r.lower(), 'atlantis')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " end"
_L = {k: f"({text})" for k, text in LINES.items()}
#: What the derived defects call for, field by field: status, raw value, similarity, distinct values, evidence.
_RESULTS = f"""
res as (
  select doc_id, 'brand_name' as field, case when doc_id % 13 = 0 then 'not_found' else 'match' end as status, case when doc_id % 13 <> 0 then brand_name end as extracted_raw, null::double as similarity_score, (doc_id % 13 <> 0)::int as n_values, {_L[1]} as evidence from apps
  union all select doc_id, 'class_type', 'match', class_type, null, 1, class_type from apps
  union all select doc_id, 'abv', case when doc_id % 11 = 0 and abv <> 45 then 'mismatch' else 'match' end, {_L[3]}, null, 1, {_L[3]} from apps
  union all select doc_id, 'net_contents', case when doc_id % 17 = 0 then 'review' else 'match' end, net_contents, null, case when doc_id % 17 = 0 then 2 else 1 end, {_L[4]} from apps
  union all select doc_id, 'producer_name', 'match', producer_name, null, 1, {_L[5]} from apps
  union all select doc_id, 'producer_address', case when doc_id % 23 = 0 then 'mismatch' when doc_id % 29 = 0 then 'not_found' else 'match' end, {_L[6]}, case when doc_id % 23 = 0 then {_ratio('louisville ky', 'nashville tn')} end, ({_L[6]} is not null)::int, {_L[6]} from apps
  union all select doc_id, 'country_origin', case when not imported_product then 'not_applicable' when doc_id % 19 = 0 then 'mismatch' else 'match' end, case when imported_product then case when doc_id % 19 = 0 then 'ATLANTIS' else country_origin end end,
    case when imported_product and doc_id % 19 = 0 then {_COUNTRY_SCORE} end, imported_product::int, {_L[7]} from apps)"""
_ORDER = "list_position(['brand_name', 'class_type', 'abv', 'net_contents', 'producer_name', 'producer_address', 'country_origin'], field)"
_WORST = "max(case when status = 'mismatch' then 3 when status in ('review', 'not_found') then 2 else 1 end)"
_ISSUES = f"coalesce(string_agg(case when status not in ('match', 'not_applicable') then replace(field, '_', ' ') || ': ' || status end, '; ' order by {_ORDER}), '')"
_COUNTS = ", ".join(f"count(*) filter (status = '{k}') as n_{k}" for k in comparison.SEVERITY)


_ABV_SQL = r"regexp_extract(text, '(?i)(\d{1,3}(?:\.\d+)?)\s*%\s*(?:a\.?\s*b\.?\s*v|alc)', 1)"
_ML = "case when lower({u}) = 'ml' then 1.0 when lower({u}) = 'l' then 1000.0 when lower({u}) = 'pint' then 473.176473 else 29.5735295625 end"


@query(for_duckdb(f"select doc_id, line_number, try_cast({_ABV_SQL} as double) as abv from lines where {_ABV_SQL} <> '' and try_cast({_ABV_SQL} as double) between 0.000001 and 100"))
def abv_candidates(spark, sf_dir):
    return extraction.abv_candidates(label_lines(spark, sf_dir)).select("doc_id", "line_number", F.col("norm_num").alias("abv"))


@query(for_duckdb(r"""
select doc_id, line_number, round(x.v * """ + _ML.format(u="x.u") + r""", 6) as ml from (
  select doc_id, line_number, unnest(list_zip(regexp_extract_all(text, '(?i)(\d+) (ml|l|pint|fl oz)', 1), regexp_extract_all(text, '(?i)(\d+) (ml|l|pint|fl oz)', 2))) as z from lines),
  lateral (select cast(z[1] as double) as v, z[2] as u) x"""))
def volume_candidates(spark, sf_dir):
    return extraction.volume_candidates(label_lines(spark, sf_dir)).select("doc_id", "line_number", F.round("norm_num", 6).alias("ml"))


@query(for_duckdb("select doc_id, line_number, lower(regexp_extract(text, '(?i)product of ([a-z ]+)$', 1)) as country from lines where text ilike 'product of %'"))
def country_candidates(spark, sf_dir):
    return extraction.country_candidates(label_lines(spark, sf_dir)).select("doc_id", "line_number", F.col("norm_text").alias("country"))


@query(for_duckdb("select doc_id, line_number, text as class_type from lines where line_number = 2"))
def class_candidates(spark, sf_dir):
    return extraction.class_candidates(label_lines(spark, sf_dir)).select("doc_id", "line_number", F.col("raw_value").alias("class_type"))


@query(for_duckdb("select doc_id, line_number, text as brand, lower(text) as norm_text from lines where line_number = 1"))
def brand_candidates(spark, sf_dir):
    """Scored lines that may be a brand; nothing else on a label passes the bars."""
    return extraction.brand_candidates(label_lines(spark, sf_dir)).select("doc_id", "line_number", F.col("raw_value").alias("brand"), "norm_text")


@query(for_duckdb("select doc_id, 'producer_name' as field, substr(text, 12) as raw_value, line_number from lines where line_number = 5 union all select doc_id, 'producer_address', text, line_number from lines where line_number = 6"))
def producer_candidates(spark, sf_dir):
    """Names behind a cue, and the address on the line after."""
    return extraction.producer_candidates(label_lines(spark, sf_dir)).select("doc_id", "field", "raw_value", "line_number")


@query(for_duckdb("select doc_id, 'abv' as field, case when abv = case when doc_id % 11 = 0 then 45 else abv end then 'match' else 'mismatch' end as status from apps where abv > 0 union all select doc_id, 'net_contents', case when doc_id % 17 = 0 then 'review' else 'match' end from apps union all select doc_id, 'country_origin', case when not imported_product then 'not_applicable' when doc_id % 19 = 0 then case when country_origin = 'ATLANTIS' then 'match' else 'mismatch' end else 'match' end from apps"))
def number_and_country_statuses(spark, sf_dir):
    """Statuses that need no similarity: equal numbers, several volumes, the country."""
    return _results(spark, sf_dir).where(F.col("field").isin("abv", "net_contents", "country_origin")).select("doc_id", "field", "status")


@query(for_duckdb(f", {_RESULTS} select doc_id, field, status, extracted_raw, similarity_score, n_values, coalesce(evidence, '') as evidence from res"))
def field_results(spark, sf_dir):
    """Statuses of all fields with evidence."""
    return _results(spark, sf_dir).select("doc_id", "field", "status", "extracted_raw", "similarity_score", "n_values", F.array_join("evidence", " | ").alias("evidence"))


@query(for_duckdb(f", {_RESULTS} select doc_id, ['match', 'review', 'mismatch'][{_WORST}] as overall_status, {_ISSUES} as issues, ['All checked application fields match the label.', 'One or more fields require manual review.', 'One or more application fields do not match the label.'][{_WORST}] as summary from res group by doc_id"))
def overall_statuses(spark, sf_dir):
    return comparison.overall(_results(spark, sf_dir))


@query(for_duckdb(f", {_RESULTS} select field, {_COUNTS} from res group by field"))
def status_counts(spark, sf_dir):
    return comparison.status_counts(_results(spark, sf_dir))


@query(for_duckdb(f", {_RESULTS} select count(distinct doc_id) as n_documents, count(distinct doc_id) filter (status = 'not_found') as n_missing_evidence from res"))
def missing_evidence(spark, sf_dir):
    return comparison.missing_evidence(_results(spark, sf_dir))


@query(for_duckdb(f", {_RESULTS} select field, {_COUNTS}, count(*) filter (status not in ('match', 'not_applicable')) as n_missed_expected, 0::bigint as n_false_confident from res group by field"))
def label_report(spark, sf_dir):
    """Counts of statuses, missed expectations and false matches by field."""
    return comparison.label_report(applications(spark, sf_dir), _results(spark, sf_dir))


#: Statuses that someone would expect who overlooks the second volumes and takes a missing brand for a mismatch.
_EXPECTED = {"brand_name": "case when doc_id % 13 = 0 then 'mismatch' else 'match' end", "class_type": "'match'", "abv": "case when doc_id % 11 = 0 and abv <> 45 then 'mismatch' else 'match' end", "net_contents": "'match'", "producer_name": "'match'",
    "producer_address": "case when doc_id % 23 = 0 then 'mismatch' when doc_id % 29 = 0 then 'not_found' else 'match' end", "country_origin": "case when not imported_product then 'not_applicable' when doc_id % 19 = 0 then 'review' else 'match' end"}
_EXPECTED_SQL = " union all ".join(f"select doc_id, '{k}' as field, {v} as expected_status from apps" for k, v in _EXPECTED.items())


def _expected(spark, sf_dir) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.expr(v).alias("expected_status")) for k, v in _EXPECTED.items())))
    return applications(spark, sf_dir).select("doc_id", each.alias("e")).select("doc_id", "e.*")


@query(for_duckdb(f""", {_RESULTS} select field, count(*) as n, count(*) filter (s = e) as n_exact, count(*) filter (s = 'match' and e <> 'match') as n_false_match, count(*) filter (s = 'mismatch' and e <> 'mismatch') as n_false_mismatch,
  count(*) filter (e = 'match' and s <> 'match') as n_missed_match, round(count(*) filter (s = e) / count(*), 4) as accuracy from (select field, status as s, expected_status as e from res join ({_EXPECTED_SQL}) using (doc_id, field)) group by field"""))
def confusion_counts(spark, sf_dir):
    """Actual against expected statuses of all fields."""
    return comparison.confusion(_expected(spark, sf_dir), _results(spark, sf_dir))


@query(for_duckdb(f""", {_RESULTS} select doc_id, string_agg(field || ': ' || expected_status || ' -> ' || status, '; ' order by field) as differences, count(*) as n_differences
  from res join ({_EXPECTED_SQL}) using (doc_id, field) where status <> expected_status group by doc_id"""))
def case_differences(spark, sf_dir):
    """Per label the checks that differ from the expected status."""
    return comparison.differences(_expected(spark, sf_dir), _results(spark, sf_dir))


@query("select event_type, quantile_cont(value, 0.5) as median_ms, quantile_disc(value, 0.9) as p90_ms, max(value) as max_ms, count(value) as n from events group by event_type")
def latency_summary(spark, sf_dir):
    return comparison.latency(_read(spark, sf_dir, "events"), ["event_type"], "value")


_KEY_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(text), 'ß', 'ss'), '''', ''), '([&@+])', ' \1 ', 'g'), '[^\p{L}\p{N}&@+]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"select item_id, {_KEY_SQL} as text_key from benchmark")
def text_keys(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", T.text_key(F.col("text")).alias("text_key"))


@query(r"""
select page_id, file_key, count(*) over (partition by file_key) > 1 as duplicate from (
  select page_id, lower(trim(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1))) as file_key from pages)""")
def duplicate_file_keys(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("image_filename"))
    return manifest.flag_duplicates(pages).select("page_id", "file_key", "duplicate")


_FILES = "select lower(p_brand) || '.png' as k, count(*) as n from part group by 1"


@query(f"select c_custkey, coalesce(n, 0) as n_files, case when n is null then 'missing' when n > 1 then 'multiple' else 'ready' end as file_status from (select c_custkey, 'brand#' || (c_custkey % 60) || '.png' as k from customer) c left join ({_FILES}) f using (k)")
def mapped_files(spark, sf_dir):
    """Records joined with files on the file key: none, one or several."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("labels\\BRAND#"), F.col("c_custkey") % 60, F.lit(".PNG")).alias("image_filename"))
    files = _read(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".png")).alias("name"))
    mapped, _ = manifest.map_files(rows.withColumn("file_key", T.filename_key(F.col("image_filename"))), files)
    return mapped.select("c_custkey", "n_files", "file_status")


@query(r"""
select doc_id, line_number, trim(regexp_replace(line, '\s+', ' ', 'g')) as text from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as line_number from documents)
where trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''""")
def numbered_lines(spark, sf_dir):
    return extraction.lines_of(_read(spark, sf_dir, "documents").select("doc_id", "text"))


_RULES = """
select o_orderkey, list_filter([case when o_totalprice % 120 <= 0 or o_totalprice % 120 > 100 then 'abv must be over 0 and at most 100' end,
  case when o_orderkey % 7 = 0 then 'net_contents must be a number and a unit' end, case when o_orderkey % 5 = 0 then 'imported_product must be true or false' end,
  case when o_orderkey % 5 <> 0 and o_orderkey % 3 = 0 then 'country_origin is required for imported products' end], lambda x: x is not null) as e from orders"""


@query(f"select o_orderkey, array_to_string(e, '; ') as errors from ({_RULES})")
def manifest_errors(spark, sf_dir):
    """All errors of every row, not the first."""
    o = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select(
        o, *(F.lit("x").alias(c) for c in ("image_filename", "brand_name", "class_type", "producer_name", "producer_address")), (F.col("o_totalprice") % 120).cast("string").alias("abv"),
        F.when(o % 7 == 0, "750 hogsheads").otherwise("750 mL").alias("net_contents"), F.when(o % 5 == 0, "yes").when(o % 3 == 0, " TRUE ").otherwise("false").alias("imported_product"), F.lit("").alias("country_origin"),
    )
    return manifest.errors_of(rows).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))



def _words(spark, sf_dir):
    """Word boxes: an order is a page, its rows with one return flag a line."""
    one = F.lit(1)
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), one.alias("page"), one.alias("block"), one.alias("paragraph"), F.col("l_returnflag").alias("line"), ((F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")).alias("ordinal"),
        (F.col("l_partkey") % 1000).cast("int").alias("left"), (F.col("l_linenumber") * 40).alias("top"), F.col("l_quantity").cast("int").alias("width"), (F.col("l_suppkey") % 50 + 10).cast("int").alias("height"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").cast("string").alias("text"),
    )


_SEGMENTS = """
with w as (select l_orderkey as doc_id, l_returnflag as line, (l_linenumber::bigint * 1000000 + l_partkey) * 100000 + l_suppkey as ordinal, cast(l_partkey % 1000 as int) as x, l_linenumber * 40 as y, cast(l_quantity as int) as width, cast(l_suppkey % 50 + 10 as int) as height from lineitem),
h as (select *, median(height) over (partition by doc_id, line) as mh, x - lag(x + width) over (partition by doc_id, line order by x, ordinal) as gap from w),
s as (select *, sum(case when gap > greatest(3.5 * mh, 80) then 1 else 0 end) over (partition by doc_id, line order by x, ordinal) as segment from h)
select doc_id, line, segment::bigint as segment, min(x) as "left", min(y) as top, (max(x + width) - min(x)) as width, (max(y + height) - min(y)) as height, median(height) as median_height, count(*) as n_words from s group by doc_id, line, segment"""


@query(_SEGMENTS)
def line_segments(spark, sf_dir):
    words = _words(spark, sf_dir)
    split = layout.split_lines(words.withColumn("image_width", F.lit(1000)))
    return layout.lines_from(split).select("doc_id", "line", "segment", "left", "top", "width", "height", "median_height", "n_words")


_PANELS = _SEGMENTS[: _SEGMENTS.rindex("select doc_id, line, segment::bigint")] + """,
g as (select doc_id, line, segment::bigint as segment, min(x) as "left", min(y) as top, max(x + width) - min(x) as width, min(ordinal) as first from s group by doc_id, line, segment),
m as (select *, count(*) over (partition by doc_id) as n, row_number() over l as pos, "left" - lag("left") over l as gap,
  quantile_cont("left" + width, 0.5) over (partition by doc_id order by "left", first, line, segment rows between unbounded preceding and 1 preceding) as r, quantile_cont("left", 0.5) over (partition by doc_id order by "left", first, line, segment rows between current row and unbounded following) as f
  from g window l as (partition by doc_id order by "left", first, line, segment)),
p as (select *, case when n >= 4 then sum(case when gap >= 120 and pos > 2 and pos <= n - 1 and r <= f + 50 then 1 else 0 end) over (partition by doc_id order by "left", first, line, segment) end::int as panel_id from m)
select doc_id, line, segment, coalesce(panel_id, -1) as panel_id, (row_number() over (partition by doc_id order by panel_id nulls last, top, "left", first, line, segment))::int as sequence_number from p"""


@query(_PANELS)
def line_panels(spark, sf_dir):
    words = _words(spark, sf_dir).withColumn("image_width", F.lit(1000))
    return layout.panels(layout.lines_from(layout.split_lines(words))).select("doc_id", "line", "segment", F.coalesce("panel_id", F.lit(-1)).alias("panel_id"), "sequence_number")


@query("select p_partkey, case when p_retailprice <= 237 then 1 when p_retailprice <= 3000 then 2 else 3 end as min_mm, case when p_retailprice <= 237 then 40 when p_retailprice <= 3000 then 25 else 12 end as max_cpi from part")
def physical_tiers(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.physical_tier(F.col("p_retailprice")).alias("t")).select("p_partkey", "t.*")


@query("select doc_id, case when t similar to '[=+\\-@].*' then '''' || t else t end as cell from (select doc_id, case when doc_id % 9 = 0 then '=' || lang when doc_id % 9 = 1 then '-' || lang else source end as t from documents)")
def exported_cells(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("="), "lang")).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("-"), "lang")).otherwise(F.col("source")).alias("cell"))
    return docs.select("doc_id", T.escaped_cell(F.col("cell")).alias("cell"))


@query(r"""select doc_id, list_position(w, 'the') is not null as has_the, len(w)::bigint as n_tokens from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents)""")
def token_phrases(spark, sf_dir):
    words = _read(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", T.phrase_index(F.col("w"), ["the"]).isNotNull().alias("has_the"), F.size("w").cast("bigint").alias("n_tokens"))


_HEADED, _ANCHORED = "regexp_matches(w, '(?i)\\bgovernment\\s+warning\\b')", "regexp_matches(w, '(?i)\\baccording\\s+to\\s+the\\s+surgeon\\s+general\\b')"


def _warned(spark, sf_dir) -> DataFrame:
    return warning.localised(warning_texts(spark, sf_dir))


@query(for_duckdb(f"select doc_id, case when {_HEADED} and {_ANCHORED} then 'match' when {_HEADED} or {_ANCHORED} then 'review' else 'not_found' end as status from warnings"))
def warning_presence(spark, sf_dir):
    return _warned(spark, sf_dir).select("doc_id", warning.presence().alias("status"))


@query(for_duckdb("select doc_id, case when w is null then 'not_found' when not regexp_matches(w, '(?i)^government warning') then 'review' when starts_with(w, 'GOVERNMENT WARNING') then 'match' else 'mismatch' end as status from warnings"))
def warning_capitals(spark, sf_dir):
    """A text without its heading begins up to 30 characters before the anchor, so its capitals are open."""
    return _warned(spark, sf_dir).select("doc_id", warning.capitalisation().alias("status"))


_STATEMENT = f"{HEADING}: {' '.join(CLAUSES)}".lower()
#: From the text: equal but for letter case, equal but for a misread or a torn word, or another text.
_WORDING = f"""case when w is null then 'not_found' when lower(w) = '{_STATEMENT}' then 'match'
  when replace(replace(lower(w), 'r1sk', 'risk'), 'drink alco holic', 'drink alcoholic') = '{_STATEMENT}' then 'review' else 'mismatch' end"""
_ORDERED = "regexp_matches(w, '(?i)surgeon general.*consumption of alcoholic beverages')"
_CAPITALS = "case when w is null then 'not_found' when not regexp_matches(w, '(?i)^government warning') then 'review' when starts_with(w, 'GOVERNMENT WARNING') then 'match' else 'mismatch' end"
_CONTINUITY = f"case when w is null then 'not_found' when not {_ORDERED} then 'mismatch' else 'review' end"


@query(for_duckdb(f"select doc_id, {_WORDING} as status from warnings"))
def warning_wording(spark, sf_dir):
    """Letter case is not wording; a missing heading or clause and another word are; a misread or a torn word is a review."""
    return _warned(spark, sf_dir).select("doc_id", warning.wording().getField("status").alias("status"))


@query(for_duckdb(f"select doc_id, {_CONTINUITY} as status from warnings"))
def warning_continuity(spark, sf_dir):
    """On plain text at best a review: there are no boxes."""
    return _warned(spark, sf_dir).select("doc_id", warning.continuity().alias("status"))


_AUTOMATED = f"case when 'mismatch' in ({_WORDING}, {_CAPITALS}, {_CONTINUITY}) then 'mismatch' when w is null then 'not_found' else 'review' end"
_CHECKS = f"select doc_id, {_AUTOMATED} as automated_status, true as manual_confirmation_required, case when w is null then 'not_found' else {_AUTOMATED} end as overall_status from warnings"


def _checked(spark, sf_dir) -> DataFrame:
    """All checks of the labels' texts, with the volumes of the applications."""
    apps = applications(spark, sf_dir)
    volume = apps.select("doc_id", T.volume(F.col("net_contents")).alias("ml"))
    return warning.checks(_warned(spark, sf_dir).join(volume, "doc_id"), F.col("ml"))


@query(for_duckdb(_CHECKS))
def warning_statuses(spark, sf_dir):
    """All checks of a label's text as one status; what needs a picture or a ruler is open."""
    return warning.statuses(_checked(spark, sf_dir))


@query(for_duckdb(f"""{", " + _RESULTS}, warned as ({_CHECKS}),
f as (select doc_id, {_WORST} as worst, {_ISSUES} as issues from res group by doc_id)
select doc_id, case when worst = 3 or automated_status = 'mismatch' then 'mismatch' when worst = 2 or automated_status <> 'match' then 'review' else 'match' end as overall_status,
  issues || case when issues <> '' then '; ' else '' end || 'government warning: ' || automated_status || ' Manual physical confirmation required.' as issues,
  case when worst = 3 or automated_status = 'mismatch' then 'One or more detected fields differ from the application or prescribed warning.' else 'One or more label checks require manual review.' end as summary
from f join warned using (doc_id)"""))
def batch_statuses(spark, sf_dir):
    """Fields and warning of a label as one status, with its issues."""
    return comparison.overall(_results(spark, sf_dir), warning.statuses(_checked(spark, sf_dir)))


_PRESENCE = f"case when {_HEADED} and {_ANCHORED} then 'match' when {_HEADED} or {_ANCHORED} then 'review' else 'not_found' end"
_OPEN = "case when w is null then 'not_found' else 'review' end"
_EACH = {"presence": _PRESENCE, "wording": _WORDING, "heading_capitalization": _CAPITALS, "heading_boldness": _OPEN, "body_not_bold": _OPEN, "continuous_statement": _CONTINUITY, "separation": _OPEN, "legibility_contrast": _OPEN, "type_size": "'review'", "characters_per_inch": "'review'"}
_LONG = " union all ".join(f"select doc_id, '{c}' as \"check\", {status} as status from warnings" for c, status in _EACH.items())


@query(for_duckdb(f""", l as ({_LONG}), o as (select doc_id, 'overall' as "check", case max(case status when 'mismatch' then 4 when 'review' then 3 when 'not_found' then 2 else 1 end) when 4 then 'mismatch' when 3 then 'review' when 2 then 'not_found' else 'match' end as status from l group by doc_id),
g as (select case when c.imported_product then 'imported' else 'domestic' end as batch, u.* from (from l union all from o) u join apps c using (doc_id)) select batch, "check", {_COUNTS} from g group by all"""))
def warning_check_counts(spark, sf_dir):
    """Counts of every check, and of the worst one of each label, by group and status."""
    batch = applications(spark, sf_dir).select("doc_id", F.when(F.col("imported_product"), "imported").otherwise("domestic").alias("batch"))
    return comparison.grouped_status_counts(_checked(spark, sf_dir).join(batch, "doc_id"), ["batch"])


_BRANDED = "w not ilike 'government warning%'"


@query(for_duckdb(f"""{WARNING_BOXES}, a as (select doc_id, w, min(x) as x, min(y) as y, max(x + width) as x2, max(y) + 20 as y2, count(*) as n, sum(confidence) as c from b group by doc_id, w),
u as (select *, {_BRANDED} as branded, {BRAND_TOP} as top from a)
select doc_id, case when branded then 'BRAND ' || w else w end as statement, n + branded::int as n_words, case when branded then least(x, 20) else x end as "left", case when branded then top else y end as top,
  case when branded then greatest(x2, 110) else x2 end - 20 as width, y2 - case when branded then top else y end as height, round((c + 0.9 * branded::int) / (n + branded::int), 6) as mean_confidence,
  case when not branded then y - (top + 20)::double end as distance from u"""))
def boxed_statements(spark, sf_dir):
    """Statements put together from word boxes, the boxes around them and the nearest other word; one without a heading begins a line above its anchor."""
    words = warning_words(spark, sf_dir)
    rows = warning.measured(warning.located(words).where("boxed"), words)
    box = [F.col(f"box.{c}").cast("bigint").alias(c) for c in layout.BOX]
    return rows.select("doc_id", "statement", F.col("n_parts").cast("bigint").alias("n_words"), *box, F.round("mean_confidence", 6).alias("mean_confidence"), F.col("distance").cast("double").alias("distance"))


@query(for_duckdb(f""", s as (select doc_id, w, {_BRANDED} as branded, {ROW_APART} as apart, {BRAND_TOP} as top, doc_id % 4 = 1 as faint from warnings where w is not null)
select doc_id, case when branded then 'review' else 'match' end as presence,
  case when contains(w, 'spaceships') and faint then 'review' else {_WORDING} end as wording, {_CAPITALS} as heading_capitalization,
  case when not {_ORDERED} then 'mismatch' when apart - 20 > 2.5 * 20 then 'review' else 'match' end as continuous_statement,
  case when branded or 200 - (top + 20) >= 1.5 * 20 then 'match' else 'review' end as separation from s"""))
def boxed_checks(spark, sf_dir):
    """The checks of labels with boxes: an uncertain wrong word is a review, wide rows and near words too."""
    words = warning_words(spark, sf_dir)
    volume = applications(spark, sf_dir).select("doc_id", T.volume(F.col("net_contents")).alias("ml"))
    rows = warning.analyse(words, volume)
    kept = ["presence", "wording", "heading_capitalization", "continuous_statement", "separation"]
    return rows.groupBy("doc_id").pivot("check", kept).agg(F.first("status")).select("doc_id", *kept)


@query("select case user_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end as batch, count(*) as n_total, count(*) filter (event_id % 4 < 2) as n_completed, count(*) filter (event_id % 4 = 2) as n_processing, count(*) filter (event_id % 4 = 1) as n_failed, greatest(count(*) - count(*) filter (event_id % 4 < 2) - count(*) filter (event_id % 4 = 2), 0) as n_remaining from events group by 1")
def batch_progress(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("match", "error", "processing", "ready"))), (F.col("event_id") % 4 + 1).cast("int"))
    batch = F.element_at(F.array(*map(F.lit, "abc")), (F.col("user_id") % 3 + 1).cast("int"))
    return comparison.progress(_read(spark, sf_dir, "events").select(batch.alias("batch"), status.alias("status")), ["batch"])


def _pixels(spark, sf_dir) -> DataFrame:
    """An embedding as a crop of 8 x 8 gray pixels."""
    each = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop"), F.posexplode("embedding").alias("at", "v"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 4) * 32).cast("int")))
    return each.select("crop", (F.col("at") % 8).alias("x"), F.floor(F.col("at") / 8).cast("int").alias("y"), level.alias("level"))


_PIXELS = """
with e as (select vec_id as crop, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
px as (select crop, i % 8 as x, i // 8 as y, least(255, greatest(0, floor((v::double + 4) * 32)::int)) as level from e),
h as (select crop, level, count(*) as c from px group by crop, level),
s as (select crop, level, sum(c) over (partition by crop order by level) as w, sum(level * c) over (partition by crop order by level) as s, sum(c) over (partition by crop) as n, sum(level * c) over (partition by crop) as t from h),
o as (select crop, coalesce(first(level order by v desc nulls last, level) filter (v is not null), 127) as threshold from (
  select *, case when w < n then w::double * (n::double - w::double) * (s::double / w::double - (t::double - s::double) / (n::double - w::double)) * (s::double / w::double - (t::double - s::double) / (n::double - w::double)) end as v from s) group by crop)"""


@query(f"{_PIXELS} select crop, threshold from o")
def otsu_thresholds(spark, sf_dir):
    return pixels.otsu(_pixels(spark, sf_dir))


@query(f"{_PIXELS} select crop, min(case when w > 0.1 * n then level end) as p10, min(case when w > 0.9 * n then level end) as p90 from s group by crop")
def level_percentiles(spark, sf_dir):
    return pixels.percentiles(_pixels(spark, sf_dir), 0.1, 0.9)


_MASK = f"""{_PIXELS},
d as (select crop, x, y, level, level <= threshold as dark from px join o using (crop)),
m as (select crop, x, y, level, dark = (2 * count(*) filter (dark) over (partition by crop) <= count(*) over (partition by crop)) as lit from d),
g as (select *, coalesce(lag(lit) over r, false) as a, coalesce(lead(lit) over r, false) as b, coalesce(lag(lit) over c, false) as e, coalesce(lead(lit) over c, false) as f from m window r as (partition by crop, y order by x), c as (partition by crop, x order by y))"""


@query(f"{_MASK} select crop, count(*) filter (lit) as area, count(*) as n, sum(case when lit then (not a)::int + (not b)::int + (not e)::int + (not f)::int else 0 end)::bigint as perimeter from g group by crop")
def mask_perimeters(spark, sf_dir):
    return pixels.perimeters(pixels.ink(_pixels(spark, sf_dir)))


@query(f"{_MASK} select crop, count(*) as n, round(abs(avg(case when lit then level end) - avg(case when not lit then level end)) / 255, 6) as contrast, round(stddev_pop(case when not lit then level end), 6) as background_std from m group by crop")
def tones(spark, sf_dir):
    """Distance of ink and background, and how calm the background is."""
    return pixels.tones(_pixels(spark, sf_dir)).select("crop", "n", F.round("contrast", 6).alias("contrast"), F.round("background_std", 6).alias("background_std"))


_BOXES = "with w as (select l_orderkey as doc_id, l_returnflag as line, (l_linenumber::bigint * 1000000 + l_partkey) * 100000 + l_suppkey as ordinal, cast(l_partkey % 1000 as int) as x, l_linenumber * 40 as y, cast(l_quantity as int) as width, cast(l_suppkey % 50 + 10 as int) as height from lineitem)"


@query(f"""{_BOXES}, r as (select doc_id, min(x) as x, min(y) as y, max(x + width) as x2, max(y + height) as y2 from w where line = 'R' group by doc_id)
select r.doc_id, round(min(case when b.doc_id is not null then sqrt(power(greatest(r.x - (b.x + b.width), b.x - r.x2, 0), 2) + power(greatest(r.y - (b.y + b.height), b.y - r.y2, 0), 2)) end), 6) as distance
from r left join (select * from w where line <> 'R') b on b.doc_id = r.doc_id group by r.doc_id""")
def nearest_boxes(spark, sf_dir):
    """The gap between the box around a region and the nearest other word."""
    words = _words(spark, sf_dir)
    near = layout.nearest_other(words, words.where("line = 'R'").select("doc_id", "ordinal"))
    return near.select("doc_id", F.round("distance", 6).alias("distance"))


@query(f"""{_BOXES} select doc_id, ordinal from w where not (doc_id % 2 = 0 and (
  (x + width / 2.0 between 200 and 700 and y + height / 2.0 between 50 and 170)
  or greatest(least(x + width, 700) - greatest(x, 200), 0) * greatest(least(y + height, 170) - greatest(y, 50), 0) >= 0.35 * width * height))""")
def words_outside_regions(spark, sf_dir):
    """Words that no excluded region of their page covers."""
    words = _words(spark, sf_dir)
    region = F.struct(F.lit(200).alias("left"), F.lit(50).alias("top"), F.lit(500).alias("width"), F.lit(120).alias("height"))
    regions = words.where("doc_id % 2 = 0").select("doc_id").distinct().select(F.col("doc_id").alias("_doc"), region.alias("_region"))
    covered = (F.col("_doc") == F.col("doc_id")) & T.overlaps(F.struct("left", "top", "width", "height"), F.col("_region"))
    return words.join(regions, covered, "left_anti").select("doc_id", "ordinal")


_AT = "(select min(i) - 1 from (select unnest(generate_series(1, len(t) - 1)) as i) where t[i] = 'surgeon' and t[i + 1] = 'general')"


@query(for_duckdb(f", k as (select doc_id, regexp_extract_all(lower(coalesce(w, '')), '[a-z0-9]+') as t from warnings) select doc_id, coalesce({_AT}, -1)::int as at, len(t)::bigint as n_tokens from k"))
def anchor_places(spark, sf_dir):
    """Where a phrase of two words stands in the statement."""
    words = warning_texts(spark, sf_dir, whole=False).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.coalesce(T.phrase_index(F.col("w"), ["surgeon", "general"]).cast("int"), F.lit(-1)).alias("at"), F.size("w").cast("bigint").alias("n_tokens"))


_PRINTED = " union all ".join(f"select doc_id, {k} as line, {text} as text, {FINER[k]} as finer from apps" for k, text in PRINTED.items())
#: Planned regions: a smudged volume stands by its strength alone; a brand or class has an uncertain word.
_PLANS = f""", p as (select * from ({_PRINTED}) where text is not null),
v as (select doc_id, line, text, finer, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as k from p),
g as (select doc_id, line, text, finer, sum(length(word) * {LETTER}) + 16 * (count(*) - 1) as width, min({WORD_CONFIDENCE}) as least from v group by doc_id, line, text, finer),
plans as (select doc_id, line, finer, case line when 1 then 'brand_name' when 2 then 'class_type' else 'net_contents' end as field, greatest(16, round(width * 0.08)) as across, case when line = 2 then 14 else 12 end as down, width from g
  where (line = 1 and least < 0.8 and not ({EXCLUDED})) or (line = 2 and least < 0.8) or (line = 4 and {SMUDGED}))"""


def _labels(spark, sf_dir):
    """Applications, candidates, results, lines and excluded regions of the labels with boxes, each written once."""
    apps, excluded = applications(spark, sf_dir), excluded_regions(spark, sf_dir)
    lines = cut(layout.read_lines(label_words(spark, sf_dir)))
    candidates = cut(extraction.extract(lines, excluded))
    return apps, candidates, cut(comparison.compare(apps, candidates)), lines, excluded


@query(for_duckdb(f"""{_PLANS} select doc_id, field, (100 - across)::bigint as "left", 100 * line - down as top, (width + 2 * across)::bigint as width, 40 + 2 * down as height, case when line = 1 then 6 else 7 end as mode,
  case when line = 4 then '' when line = 1 then '1' when doc_id % 13 = 0 then '1' else '2' end as source_lines from plans"""))
def refinement_plans(spark, sf_dir):
    """Which regions to read again: partners of missing volumes, and lines of uncertain brands and classes."""
    _, candidates, results, lines, excluded = _labels(spark, sf_dir)
    planned = refinement.plans(results, candidates, lines, excluded)
    box = [F.col(c).cast("bigint").alias(c) for c in ("left", "width")]
    return planned.select("doc_id", "field", *box, "top", "height", "mode", F.array_join(F.col("source_lines").cast("array<string>"), ",").alias("source_lines"))


def _refined(spark, sf_dir) -> refinement.Refinement:
    apps, candidates, results, lines, excluded = _labels(spark, sf_dir)
    return refinement.refine(apps, candidates, results, lines, refinement.from_words(label_words(spark, sf_dir, finer=True)), excluded)


_ACCEPTED = f"({FINER_CONFIDENCE} >= 0.55 and case line when 1 then finer <> 'ZZZZ QQQQ' when 4 then finer not like '% 375 mL' else true end)"


@query(for_duckdb(f"{_PLANS} select doc_id, field, finer as refined_text, {_ACCEPTED} as selected, {FINER_CONFIDENCE}::double as mean_confidence from plans"))
def accepted_readings(spark, sf_dir):
    """What second readings say and which are surer than the first: one candidate, about the same text, certain word by word."""
    return _refined(spark, sf_dir).evidence.select("doc_id", "field", "refined_text", "selected", F.round("mean_confidence", 6).alias("mean_confidence"))


@query(for_duckdb(f"""{_PLANS}, a as (select doc_id, field, {_ACCEPTED} as selected from plans where line = 4)
select doc_id, 'brand_name' as field, case when doc_id % 13 = 0 or {EXCLUDED} then 'not_found' else 'match' end as status from apps union all select doc_id, 'class_type', 'match' from apps
union all select doc_id, 'net_contents', case when {SMUDGED} then case when a.selected then 'match' else 'not_found' end when doc_id % 17 = 0 then 'review' else 'match' end from apps left join a using (doc_id)"""))
def refined_results(spark, sf_dir):
    """Fields compared again where a second reading replaced the first."""
    return _refined(spark, sf_dir).results.where(F.col("field").isin(*refinement.ORDER)).select("doc_id", "field", "status")


#: Labels as plain pages; every 31st is not in UTF-8.
_SPOILT = "doc_id % 31 = 5"


@query(for_duckdb(f"""select doc_id, case when not ({_SPOILT}) then string_agg(text, chr(10) order by line_number) end as text, case when {_SPOILT} then 'processing' end as error,
  case when {_SPOILT} then 0 else sum(len(string_split(text, ' '))) end::bigint as n_words, case when {_SPOILT} then 0 else max(length(text)) * 10 end::bigint as image_width from lines group by doc_id"""))
def service_readings(spark, sf_dir):
    """What a reading service finds on every label, and the code of what it cannot read."""
    line = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    pages = label_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(line, lambda l: l.text), "\n").alias("t"))
    content = F.when(F.expr(_SPOILT), F.concat(F.unhex(F.lit("FF")), F.encode("t", "UTF-8"))).otherwise(F.encode("t", "UTF-8"))
    got = reading.read(pages.select("doc_id", content.alias("content"), F.lit("text/plain").alias("media_type")), reading.PlainPages())
    sizes = got.words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.max("image_width").cast("bigint").alias("image_width"))
    return got.outcomes.join(sizes, "doc_id", "left").select("doc_id", "text", "error", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("image_width", F.lit(0)).alias("image_width"))


#: The crops of a label: its warning, and the left half of it; a file has the labels of a hundred ids.
_CROPS = {"whole": (0, 190, 1000, 800), "half": (0, 190, 400, 800)}


def _heldout(spark, sf_dir) -> DataFrame:
    """Crops that JSON files of labels with a printed warning name, with the label's id."""
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.concat(F.lit("https://labels.example/"), "doc_id", F.lit(".png?full")).alias("source"), F.array(*map(F.lit, box)).alias("crop")) for n, box in _CROPS.items()))
    each = applications(spark, sf_dir).select("doc_id", F.explode(named).alias("c"))
    files = each.groupBy(F.floor(F.col("doc_id") / 100).alias("path")).agg(F.to_json(F.struct(F.array_sort(F.collect_list("c")).alias("heldout"))).alias("evidence"))
    found = crops.crops(files).where("error is null")
    return found.withColumn("doc_id", F.regexp_extract("image", r"\A\d+", 0).cast(each.schema["doc_id"].dataType)).withColumn("crop", F.concat_ws("/", "doc_id", "name"))


@query(for_duckdb(f"""{WARNING_BOXES}, c as (select * from (values {', '.join(f"('{n}', {x}, {y}, {r}, {b})" for n, (x, y, r, b) in _CROPS.items())}) c(name, l, t, r, b))
select doc_id, name, count(*) as n_words, min(x - l) as "left", max(least(x + width, r) - l) as "right", string_agg(text, ' ' order by k) as text
from b, c where x + width / 2.0 >= l and x + width / 2.0 < r and y + 10 >= t and y + 10 < c.b group by doc_id, name"""))
def heldout_words(spark, sf_dir):
    """The words that stand in held-out crops, cut to them and counted from their corners."""
    regions = _heldout(spark, sf_dir)
    held = crops.words_in(regions, warning_words(spark, sf_dir)).groupBy(F.col("doc_id").alias("crop")).agg(
        F.count("*").alias("n_words"), F.min("left").cast("bigint").alias("left"), F.max(F.col("left") + F.col("width")).cast("bigint").alias("right"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda w: w.text), " ").alias("text")
    )
    return held.join(regions.select("crop", "doc_id", "name"), "crop").drop("crop")


@query(for_duckdb(f"""select 'whole' as "group", "check", {_COUNTS} from (
  select 'presence' as "check", {_PRESENCE} as status from warnings union all select 'heading_capitalization', {_CAPITALS} from warnings union all select 'continuous_statement', case when w is null then 'not_found' when not {_ORDERED} then 'mismatch' when {ROW_APART} - 20 > 2.5 * 20 then 'review' else 'match' end from warnings
  union all select 'separation', case when w is null then 'not_found' else 'match' end from warnings) group by "check" """))
def heldout_check_counts(spark, sf_dir):
    """Checks of the whole warnings among held-out crops: no other word is in a crop, so nothing is near."""
    regions = _heldout(spark, sf_dir).where("name = 'whole'")
    checks = crops.checked(regions, warning_words(spark, sf_dir)).where(F.col("check").isin("presence", "heading_capitalization", "continuous_statement", "separation"))
    return crops.report(regions.select(F.col("crop").alias("doc_id"), F.col("name").alias("group")), checks).where("check <> 'overall'")


_N_CANDIDATES = "(doc_id % 13 <> 0)::int + 4 + (doc_id % 17 = 0)::int + (doc_id % 23 = 0 or doc_id % 29 <> 0)::int + imported_product::int"


@query(for_duckdb(f"""{", " + _RESULTS}, f as (select doc_id, ['All checked application fields match the label.', 'One or more fields require manual review.', 'One or more application fields do not match the label.'][{_WORST}] as summary, max(status) filter (field = 'brand_name') as brand, max(status) filter (field = 'country_origin') as country from res group by doc_id)
select doc_id, '' as errors, summary, brand, country, ({_N_CANDIDATES})::bigint as n_candidates, w is not null as located, {_WORDING} as wording, 1::bigint as n_readings from apps join f using (doc_id) join warnings using (doc_id)"""))
def verification_responses(spark, sf_dir):
    """Whole responses of the labels, read back from their JSON."""
    apps = applications(spark, sf_dir)
    candidates = cut(extraction.extract(lines_of_applications(apps)))
    results = cut(comparison.compare(apps, candidates))
    texts = warning_texts(spark, sf_dir)
    readings = texts.withColumns({"engine": F.lit("plain"), "duration_ms": F.lit(1.0), "total_ms": F.lit(2.0), "warnings": F.lit(None).cast("array<string>")})
    rows = response.responses(apps, candidates, results, comparison.overall(results), readings, _warned(spark, sf_dir), _checked(spark, sf_dir))

    def told(v):
        at = lambda path, kind="string": F.try_variant_get(v, path, kind)
        n = sum((F.size(at(f"$.candidates.{f}", "array<variant>")) for f in comparison.FIELDS), F.lit(0)).cast("bigint")
        return F.struct(
            F.array_join(response.shape_errors_of(v), "; ").alias("errors"), at("$.overall_summary").alias("summary"), at("$.results.brand_name.status").alias("brand"), at("$.results.country_origin.status").alias("country"), n.alias("n_candidates"),
            at("$.government_warning.localized_text").isNotNull().alias("located"), response.check_statuses_of(v)[1].alias("wording"), at("$.ocr_invocation_count", "bigint").alias("n_readings"),
        )

    return rows.select("doc_id", response.parsed_once(F.col("response"), told).alias("t")).select("doc_id", "t.*")


#: Responses of another service: a missing summary, a number in quotes, a list for an object, an unknown status, an explanation that is a number, a field left out, or text that ends too soon.
_PAYLOAD = (
    "concat('{\"overall_summary\": ', case doc_id % 9 when 1 then 'null' else '\"fine\"' end, ', \"raw_text\": \"', class_type, '\", \"engine\": \"plain\", \"total_verification_duration_ms\": ', case doc_id % 9 when 2 then '\"12\"' else cast(cast(abv as int) as varchar(9)) end, "
    "', \"ocr_duration_ms\": 8.5, \"government_warning\": ', case doc_id % 9 when 3 then '[]' else '{}' end, ', \"results\": {', "
    + ", ', ', ".join(
        f"'\"{f}\": {{\"status\": \"', case when doc_id % 9 = 4 and doc_id % 7 = {k} then 'fine' else 'match' end, '\", \"explanation\": ', case when doc_id % 9 = 5 and doc_id % 7 = {k} then '1' else '\"as stated\"' end, '}}'" if k else f"case doc_id % 9 when 6 then '\"more\": 1' else '\"{f}\": {{\"status\": \"review\", \"explanation\": \"near\"}}' end"
        for k, f in enumerate(comparison.FIELDS)
    )
    + ", case doc_id % 9 when 7 then '}' else '}}' end)"
)
_STATUSES = ", ".join(f"'{s}'" for s in comparison.SEVERITY)
_SHAPE = ", ".join(
    [f"case when coalesce(json_type(j, '$.{c}'), '') <> 'VARCHAR' then '{c} is no text' end" for c in response.TEXTS]
    + [f"case when coalesce(json_type(j, '$.{c}'), '') not in ('BIGINT', 'UBIGINT', 'DOUBLE') then '{c} is no number' end" for c in response.NUMBERS]
    + [f"case when coalesce(json_type(j, '$.{c}'), '') <> 'OBJECT' then '{c} is no object' end" for c in response.OBJECTS]
    + [t for f in comparison.FIELDS for t in (f"case when coalesce(json_extract_string(j, '$.results.{f}.status') not in ({_STATUSES}), true) then '{f} has no known status' end", f"case when coalesce(json_type(j, '$.results.{f}.explanation'), '') <> 'VARCHAR' then '{f} has no explanation' end")]
)


@query(for_duckdb(f"""select doc_id, case when j is null then 'not a JSON object' else array_to_string(list_filter([{_SHAPE}], lambda x: x is not null), '; ') end as errors
from (select doc_id, case when json_valid(p) then p::json end as j from (select doc_id, {_PAYLOAD} as p from apps))"""))
def response_errors(spark, sf_dir):
    """What is wrong with responses of another service."""
    return applications(spark, sf_dir).select("doc_id", F.array_join(response.shape_errors(F.expr(_PAYLOAD)), "; ").alias("errors"))


_KIND = f"[{', '.join(f"'{k}'" for k in generated.KINDS)}][doc_id % {len(generated.KINDS)} + 1]"
_CASE_CHECKS = ", ".join(f"'{c}'" for c in (*generated.FIELDS, *generated.WARNING_CHECKS))


@query(for_duckdb(f"""select {_KIND} as kind, field, count(*) as n_cases, count(*) as n_exact, 0::bigint as n_false_match, 0::bigint as n_false_mismatch from apps, unnest([{_CASE_CHECKS}]) c(field) group by all"""))
def generated_cases(spark, sf_dir):
    """Every application as a case of one kind, run through fields and warning, and judged: each case gives what its kind calls for."""
    cases = generated.cases(applications(spark, sf_dir))
    lines, texts = generated.printed(cases)
    fields = comparison.compare(cases, extraction.extract(lines)).select("doc_id", "field", "status")
    volume = cases.select("doc_id", T.volume(F.col("net_contents")).alias("ml"))
    checks = warning.checks(warning.localised(texts).join(volume, "doc_id"), F.col("ml")).where(F.col("check").isin(*generated.WARNING_CHECKS)).select("doc_id", F.col("check").alias("field"), "status")
    told = evaluation.judged(generated.expected(cases), fields.unionByName(checks))
    counted = {f"n_{v}": F.count_if(F.col("verdict") == v) for v in ("exact", "false_match", "false_mismatch")}
    return told.groupBy("kind", "field").agg(F.count("*").alias("n_cases"), *(c.alias(n) for n, c in counted.items()))
