"""Applications and label lines derived from the star-schema tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES = ("part", "supplier", "nation", "region")
#: Every 11th label states another strength, every 13th no brand, every 17th two volumes, every 19th another country,
#: every 23rd another address, every 29th none.
APPLICATIONS = """
select p.p_partkey as doc_id, upper(p.p_name) as brand_name,
  case p.p_partkey % 6 when 0 then 'Straight Bourbon Whiskey' when 1 then 'London Dry Gin' when 2 then 'India Pale Ale' when 3 then 'Red Wine' when 4 then 'Spiced Rum' else 'Silver Tequila' end as class_type,
  cast(p.p_size as double) as abv,
  case p.p_partkey % 4 when 0 then '750 mL' when 1 then '1 L' when 2 then '12 FL OZ' else '1 PINT' end as net_contents,
  upper(s.s_name) as producer_name, 'Louisville, Kentucky' as producer_address,
  p.p_partkey % 3 = 0 as imported_product, case when p.p_partkey % 3 = 0 then r.r_name end as country_origin
from {part} p join {supplier} s on s.s_suppkey = p.p_partkey % (select count(*) from {supplier})
  join {nation} a on a.n_nationkey = s.s_nationkey join {region} r on r.r_regionkey = a.n_regionkey
"""
#: Text of a line by its number; a line without text is not printed.
LINES = {
    1: "case when doc_id % 13 <> 0 then brand_name end",
    2: "class_type",
    3: "case when doc_id % 11 = 0 then '45% ABV' else concat(cast(cast(abv as int) as varchar(9)), '% Alc/Vol') end",
    4: "case when doc_id % 17 = 0 then concat(net_contents, ' 375 mL') else net_contents end",
    5: "concat('Bottled by ', producer_name)",
    6: "case when doc_id % 23 = 0 then 'NASHVILLE, TN' when doc_id % 29 <> 0 then 'LOUISVILLE, KY' end",
    7: "case when imported_product then concat('Product of ', case when doc_id % 19 = 0 then 'ATLANTIS' else country_origin end) end",
}
#: Fixed value: the health warning that the law prescribes.
HEADING, CLAUSES = "GOVERNMENT WARNING", (
    "(1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects.",
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems.",
)
#: None, a heading in small letters, without the second clause, without a heading, with a wrong word, with a misread one, with a torn one, or whole.
WARNING_TEXT = f"""case doc_id % 9 when 0 then null when 1 then 'Government Warning: {CLAUSES[0]} {CLAUSES[1]}' when 2 then '{HEADING}: {CLAUSES[0]}'
  when 3 then '{CLAUSES[0]} {CLAUSES[1]}' when 4 then replace('{HEADING}: {CLAUSES[0]} {CLAUSES[1]}', 'machinery', 'spaceships') when 5 then replace('{HEADING}: {CLAUSES[0]} {CLAUSES[1]}', 'risk', 'r1sk')
  when 6 then replace('{HEADING}: {CLAUSES[0]} {CLAUSES[1]}', 'drink alcoholic', 'drink alco holic') else '{HEADING}: {CLAUSES[0]} {CLAUSES[1]}' end"""
#: The warning printed six words a row behind a brand: where the brand stands, the rows' distance, and how certain words are.
ROW_WORDS, WARNING_TOP = 6, 200
BRAND_TOP = "case when doc_id % 3 = 0 or w not ilike 'government warning%' then 178 else 20 end"
ROW_APART = "case when doc_id % 5 = 2 then 75 else 40 end"
CERTAIN = "case when doc_id % 4 = 1 then 0.6 else 0.95 end"


def for_duckdb(query: str) -> str:
    lines = " union all ".join(f"select doc_id, {k} as line_number, {text} as text from apps" for k, text in LINES.items())
    return f"with apps as ({APPLICATIONS.format(**{t: t for t in _TABLES})}), lines as (select * from ({lines}) where text is not null), warnings as (select doc_id, {WARNING_TEXT} as w from apps) {query}"


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applications, dealt over tasks by their id while they are narrow: a small file is one task, and what is made of an application is many times its size and stays where it is."""
    rows = spark.sql(APPLICATIONS.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _TABLES}))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def lines_of_applications(apps: DataFrame) -> DataFrame:
    """The lines of every label, from one pass over the applications."""
    printed = F.array(*(F.struct(F.lit(k).alias("line_number"), F.expr(text).alias("text")) for k, text in LINES.items()))
    return apps.select("doc_id", F.explode(printed).alias("line")).select("doc_id", "line.*").where("text is not null")


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_applications(applications(spark, sf_dir))


def warning_texts(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """(doc_id, text): the whole text of every label, the warning last, or the warning alone."""
    every = [*LINES.values(), WARNING_TEXT] if whole else [WARNING_TEXT]
    return applications(spark, sf_dir).select("doc_id", F.concat_ws("\n", *(F.expr(t) for t in every)).alias("text"))


def warning_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of printed warnings with their boxes, behind the word BRAND; labels without a warning have no words."""
    printed = applications(spark, sf_dir).select("doc_id", F.expr(WARNING_TEXT).alias("w")).where("w is not null")
    words = printed.select("doc_id", "w", F.split("w", " ").alias("words"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / ROW_WORDS).cast("int")), lambda r: F.slice("words", r * ROW_WORDS + 1, ROW_WORDS))
    of_row = words.select("doc_id", "w", F.posexplode(F.concat(F.array(F.array(F.lit("BRAND"))), rows)).alias("line", "row"))
    of_word = of_row.select("doc_id", "w", "line", "row", F.posexplode("row").alias("k", "text"))
    brand, at = F.col("line") == 0, F.col("line") - 1
    left = F.aggregate(F.slice("row", F.lit(1), F.col("k")), F.lit(20), lambda s, before: s + 8 * F.length(before) + 12)
    each = of_word.select(
        "doc_id", F.when(brand, 0).otherwise(at * ROW_WORDS + F.col("k") + 1).alias("ordinal"), "line", left.alias("left"), F.when(brand, F.expr(BRAND_TOP)).otherwise(WARNING_TOP + at * F.expr(ROW_APART)).alias("top"),
        F.when(brand, 90).otherwise(8 * F.length("text")).alias("width"), F.when(brand, 0.9).otherwise(F.expr(CERTAIN).cast("double")).alias("confidence"), "text",
    )
    one = F.lit(1)
    return each.select("doc_id", "ordinal", one.alias("page"), one.alias("block"), one.alias("paragraph"), "line", "left", "top", "width", F.lit(20).alias("height"), "confidence", "text", F.lit(1000).alias("image_width"), F.lit(800).alias("image_height"))


#: The same words for DuckDB, behind for_duckdb: b(doc_id, w, k, text, x, y, width, confidence), k from 0, without the brand.
WARNING_BOXES = f""", t as (select doc_id, w, unnest(string_split(w, ' ')) as text, generate_subscripts(string_split(w, ' '), 1) - 1 as k from warnings where w is not null),
b as (select doc_id, w, k, text, 20 + coalesce(sum(8 * length(text) + 12) over (partition by doc_id, k // {ROW_WORDS} order by k rows between unbounded preceding and 1 preceding), 0) as x,
  {WARNING_TOP} + (k // {ROW_WORDS}) * {ROW_APART} as y, 8 * length(text) as width, {CERTAIN}::double as confidence from t)"""


#: Labels with boxes: every fifth has a smudged volume; a word in nine is uncertain. A finer reading has the true text, for a quarter of the labels as uncertain, for a quarter with another brand.
SMUDGED, EXCLUDED = "doc_id % 5 = 0", "doc_id % 11 = 4"
PRINTED = {k: f"case when {SMUDGED} then '7 5 0 #' else {text} end" if k == 4 else text for k, text in LINES.items()}
FINER = {k: f"case when doc_id % 4 = 3 and doc_id % 13 <> 0 then 'ZZZZ QQQQ' else {text} end" if k == 1 else text for k, text in LINES.items()}
LETTER = f"case when line = 4 and {SMUDGED} then 54 else 18 end"
WORD_CONFIDENCE = "case when (doc_id + 2 * line + k) % 9 = 0 then 0.6 else 0.95 end"
FINER_CONFIDENCE = "case when doc_id % 4 = 1 then 0.5 else 0.95 end"


def label_words(spark: SparkSession, sf_dir: str, finer: bool = False) -> DataFrame:
    """The words of labels with their boxes: a line every 100 pixels, its words from 100 on, 16 apart."""
    lines, letter, confidence = (FINER, "18", FINER_CONFIDENCE) if finer else (PRINTED, LETTER, WORD_CONFIDENCE)
    printed = F.array(*(F.struct(F.lit(k).alias("line"), F.expr(text).alias("text")) for k, text in lines.items()))
    rows = applications(spark, sf_dir).select("doc_id", F.explode(printed).alias("l")).select("doc_id", "l.line", F.split("l.text", " ").alias("words")).where("words is not null").withColumn("letter", F.expr(letter))
    word = F.transform("words", lambda w, k: F.struct(k.alias("k"), w.alias("text"), F.aggregate(F.slice("words", 1, k), F.lit(100), lambda s, b: s + F.length(b) * F.col("letter") + 16).alias("left")))
    each = rows.select("doc_id", "line", "letter", F.explode(word).alias("w")).select("doc_id", "line", "letter", "w.*")
    one = F.lit(1)
    return each.select(
        "doc_id", (F.col("line") * 100 + F.col("k")).alias("ordinal"), one.alias("page"), one.alias("block"), one.alias("paragraph"), "line", "left", (F.col("line") * 100).alias("top"), (F.length("text") * F.col("letter")).alias("width"), F.lit(40).alias("height"),
        F.expr(confidence).cast("double").alias("confidence"), "text", F.lit(1600).alias("image_width"), F.lit(1200).alias("image_height"),
    )


def excluded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region over the first line of some labels."""
    return applications(spark, sf_dir).where(EXCLUDED).select("doc_id", F.lit(0).alias("left"), F.lit(80).alias("top"), F.lit(1600).alias("width"), F.lit(80).alias("height"))
