"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import additive_ann, chunk_dedup, decontaminate, delta_lloyd, html_extract, jaccard_join, language_id, line_dedup, merkle, ngram_lm, packing, quality, warc

MODULES = {
    "op1_packing": packing,
    "op2_html_extraction": html_extract,
    "op3_quality_classifier": quality,
    "op4_line_dedup": line_dedup,
    "op5_additive_ann": additive_ann,
    "op6_lm_scoring": ngram_lm,
    "op7_substring_dedup": chunk_dedup,
    "op8_decontamination": decontaminate,
    "op9_warc_derivatives": warc,
    "op10_ngram_jaccard_join": jaccard_join,
    "op11_centroid_clustering": delta_lloyd,
    "op12_language_id": language_id,
    "op13_merkle_manifest": merkle,
}

QUERIES = {name: m.query for name, m in MODULES.items()}
ORACLE_SQL = {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
