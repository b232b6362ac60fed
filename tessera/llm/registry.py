"""Queries of the corpus operators and the SQL of those that have any."""

from __future__ import annotations

from tessera.llm import decontamination, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, line_dedup, lm_scoring, packing, periodic_runs, simhash, suffix_dedup, token_counts

MODULES = (packing, language_id, line_dedup, simhash, html_text, decontamination, exact_dedup, suffix_dedup, token_counts, lm_scoring, jaccard_join, periodic_runs, hard_negatives)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
