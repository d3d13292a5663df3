"""The queries of this subpackage and, where SQL can state their results, the SQL."""

from __future__ import annotations

from varve.llm import bpe, exact_dedup, filter_audit, hard_negatives, html_text, lm_score, mixing, neighbours, packing, simhash, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_packing": packing.op7_packing,
    "op8_html_text": html_text.op8_html_text,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_simhash": simhash.op10_simhash,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_bpe": bpe.op12_bpe,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
SQL = {"op1_substring_dedup": substring_dedup.SQL, "op4_exact_dedup": exact_dedup.SQL, "op5_url_filter": url_filter.SQL, "op11_filter_audit": filter_audit.SQL, "op13_hard_negatives": hard_negatives.SQL}
