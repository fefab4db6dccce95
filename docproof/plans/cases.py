"""Generated evaluation cases: each application becomes a label of one kind, with the statuses that a right run gives it.

Nothing is drawn by chance, so a case is the same in every run: its kind follows from its id and a seed, and cases of
every kind grow with the applications. Cases are text; what only a picture shows is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docproof.plans.label_data import CLAUSES, HEADING

#: The kinds of cases.
KINDS = (
    "clean_domestic", "clean_imported", "wrapped_producer", "formatting_variation", "wrong_brand", "wrong_abv_and_volume", "wrong_country", "altered_warning_wording", "warning_heading_case",
    "missing_abv", "missing_import_origin", "missing_warning", "partial_producer_address", "multiple_responsible_entities",
)
IMPORTED = ("clean_imported", "wrong_country", "missing_import_origin")
FIELDS = ("brand_name", "class_type", "abv", "net_contents", "producer_name", "producer_address", "country_origin")
WARNING_CHECKS = ("presence", "wording", "heading_capitalization")
#: Statuses of a kind that are not those of a clean label.
EXPECTED = {
    "wrong_brand": {"brand_name": "mismatch"},
    "wrong_abv_and_volume": {"abv": "mismatch", "net_contents": "mismatch"},
    "wrong_country": {"country_origin": "mismatch"},
    "altered_warning_wording": {"wording": "mismatch"},
    "warning_heading_case": {"heading_capitalization": "mismatch"},
    "missing_abv": {"abv": "not_found"},
    "missing_import_origin": {"country_origin": "not_found"},
    "missing_warning": dict.fromkeys(WARNING_CHECKS, "not_found"),
    "partial_producer_address": {"producer_address": "review"},
    "multiple_responsible_entities": {"producer_name": "review", "producer_address": "review"},
}


def kind_of(doc_id: Column, seed: int) -> Column:
    """The kind of a case; the seed turns the kinds round."""
    return F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(doc_id + seed, F.lit(len(KINDS))) + 1).cast("int"))


def cases(applications: DataFrame, seed: int = 0) -> DataFrame:
    """The applications as they are filed for their cases, with kind and lines, the printed lines of the label.

    An application without a brand or class has no such line; one without a country is imported from France where its
    kind is imported; equal ids give equal cases.
    """
    kind = F.col("kind")
    imported = kind.isin(*IMPORTED)
    filed = applications.withColumn("kind", kind_of(F.col("doc_id"), seed)).withColumns({
        "imported_product": imported, "country_origin": F.when(imported, F.coalesce("country_origin", F.lit("France"))), "producer_address": F.when(kind == "partial_producer_address", "123 Main Street, Louisville, Kentucky").otherwise("Louisville, Kentucky"),
    })
    is_ = lambda name: kind == name
    number = F.col("abv").cast("decimal(5,1)").cast("string")
    percent = F.when(is_("formatting_variation"), F.concat(number, F.lit("% Alc./Vol."))).when(is_("wrong_abv_and_volume"), F.when(F.col("abv") == 45, "40% ABV").otherwise("45% ABV")).when(~is_("missing_abv"), F.concat(number, F.lit("% ABV")))
    volume = F.when(is_("formatting_variation"), F.lower("net_contents")).when(is_("wrong_abv_and_volume"), "375 mL").otherwise(F.col("net_contents"))
    by = F.when(is_("wrapped_producer"), F.array(F.lit("BREWED BY"), F.col("producer_name"))).otherwise(F.array(F.concat(F.lit("BOTTLED BY "), "producer_name")))
    other = F.when(is_("multiple_responsible_entities"), F.array(F.lit("PRODUCED BY CENTRAL COAST BOTTLING"), F.lit("FRESNO, CA"))).otherwise(F.array())
    origin = F.when(imported & ~is_("missing_import_origin"), F.concat(F.lit("PRODUCT OF "), F.when(is_("wrong_country"), "SPAIN").otherwise(F.upper("country_origin"))))
    heading = F.when(is_("warning_heading_case"), f"{HEADING.title()}:").otherwise(f"{HEADING}:")
    end = F.when(is_("altered_warning_wording"), CLAUSES[1].replace("health problems", "health benefits")).otherwise(CLAUSES[1])
    stated = F.when(is_("missing_warning"), F.array()).otherwise(F.array(F.concat(heading, F.lit(f" {CLAUSES[0]}")), end))
    brand = F.when(is_("wrong_brand"), "OLD TOM RESERVE").otherwise(F.upper("brand_name"))
    named = F.when(is_("formatting_variation"), F.upper("class_type")).otherwise(F.col("class_type"))
    lines = F.concat(F.array(brand, named, percent, volume), by, F.array(F.lit("LOUISVILLE, KY")), other, F.array(origin), stated)
    return filed.withColumn("lines", F.array_compact(lines))


def printed(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of the labels (doc_id, line_number, text), and their whole texts (doc_id, text)."""
    each = cases.select("doc_id", F.posexplode("lines").alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line_number"), "text")
    return each, cases.select("doc_id", F.array_join("lines", "\n").alias("text"))


def expected(cases: DataFrame) -> DataFrame:
    """(doc_id, kind, field, expected_status) of the fields and of the warning's checks that a text decides."""
    kind = F.col("kind")

    def status(check: str) -> Column:
        told = F.when(F.lit(False), "")
        for name, own in EXPECTED.items():
            if check in own:
                told = told.when(kind == name, own[check])
        clean = F.when(kind.isin(*IMPORTED), "match").otherwise("not_applicable") if check == "country_origin" else F.lit("match")
        return told.otherwise(clean)

    each = F.array(*(F.struct(F.lit(c).alias("field"), status(c).alias("expected_status")) for c in (*FIELDS, *WARNING_CHECKS)))
    return cases.select("doc_id", "kind", F.explode(each).alias("e")).select("doc_id", "kind", "e.*")
