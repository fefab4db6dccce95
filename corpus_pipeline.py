"""From raw documents to packed training sequences, in four stages that each keep to their predecessor's output.

Each stage reads the table that the one before wrote; what that one stored on the way is deleted then. What a pass
stores belongs to it alone: passes may run side by side, each in a thread.

Defined cases: a null text, or one without words, has too few words and goes in the first stage; of rows with equal
ids the one whose text's hash is smallest stays if they are near copies, else both; of fully equal rows one stays;
a document whose units all go in the third stage stays with an empty text and is packed as one end token; extra
columns stay until the last stage; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docproof.llm import jaccard_join, line_dedup, packing, quality
from docproof.llm.common import release, scope, stored

#: The pass of this thread; it begins with the first stage.
_PASS: ContextVar[str] = ContextVar("pass", default="pipeline")
#: SQL cannot express tokenization, so run() is tested against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' policy rejects go."""
    _PASS.set(f"pipeline {uuid.uuid4().hex}")
    with scope(_PASS.get()):
        return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    release(spark, _PASS.get(), docs)
    with scope(_PASS.get()):
        return jaccard_join.keep_first(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines, sentences and passages go but for their first occurrence; n_chars follows the text."""
    release(spark, _PASS.get(), docs)
    with scope(_PASS.get()):
        done = line_dedup.dedup(docs)
    return done.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    release(spark, _PASS.get(), docs)
    with scope(_PASS.get()):
        return packing.packed_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with scope(_PASS.get()):
                docs = stored(docs, name)
    return docs
