"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

import corpus_pipeline
from docproof.llm import curve_search, fill_middle, html_extraction, jaccard_join, line_dedup, packing, personal_data, quality, sentencepiece_codec, suffix_dedup, token_alignment, token_counts, url_filters

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_packing": packing.op4_packing,
    "op5_nearest": curve_search.op5_nearest,
    "op6_substring_dedup": line_dedup.op6_substring_dedup,
    "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_personal_data": personal_data.op13_personal_data,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op8_quality_rules": quality.ORACLE_SQL}
