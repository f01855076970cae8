"""The queries of this subpackage: name -> function of (spark, sf_dir), and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import bpe, ctw, decontam, html_extract, jaccard, quality, sharding, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_ctw": ctw.op4_ctw,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_sharding": sharding.op9_sharding,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
}
