"""The queries of this folder and their SQL."""

from __future__ import annotations

from linequarry.llm import exact_dedup, html_extraction, language_id, license_scan, mixing, quality_rules, sentencepiece_unigram, simhash_dedup, substring_dedup, url_filters

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_language_id": language_id.op5_language_id,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_suffix_array_dedup": substring_dedup.op8_suffix_array_dedup,
    "op9_sentencepiece": sentencepiece_unigram.op9_sentencepiece,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op7_url_filters": url_filters.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
