"""Operators for preparing large text corpora. Nothing else in the package imports this one.

All modules are imported at once, so a part that can't be imported shows here and not when queries are listed.
"""

from __future__ import annotations

from . import decontamination, embedding_dedup, importance_sampling, language_id, license_scan, line_dedup, ngram_join, quality, sentencepiece_tokens, spelling_variants, substring_dedup, topk_search, warc_fixity

MODULES = (ngram_join, substring_dedup, language_id, line_dedup, warc_fixity, quality, license_scan, sentencepiece_tokens, decontamination, topk_search, spelling_variants, embedding_dedup, importance_sampling)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
