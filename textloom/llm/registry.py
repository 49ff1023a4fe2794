"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from textloom.llm import byte_bpe, decontaminate, external_shuffle, html_extract, kd_search, language_id, near_dedup, pii, token_files, toxicity

_MODULES = (byte_bpe, decontaminate, external_shuffle, html_extract, kd_search, language_id, near_dedup, pii, token_files, toxicity)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
