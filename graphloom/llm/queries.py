"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from graphloom.llm import collocations, decontamination, embedding_dedup, fill_in_middle, line_dedup, lm_scoring, media_ts, packing, quality, simhash, substring_dedup, suffix_dedup, token_counts

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_quality": quality.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_media_ts": media_ts.query,
    "op5_decontamination": decontamination.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_token_counts": token_counts.query,
    "op8_best_fit_packing": packing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_simhash": simhash.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_embedding_dedup": embedding_dedup.query,
    "op13_collocations": collocations.query,
}

SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_embedding_dedup": embedding_dedup.SQL,
    "op13_collocations": collocations.SQL,
}
