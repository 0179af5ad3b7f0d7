"""Operators for training-data pipelines; nothing else in the library imports them."""

from parcelbook.llm import decontaminate, exact_dedup, hard_negatives, language_id, license_scan, lm_scoring, mixing, phrases, pivot_search, simhash, suffix_dedup, toxicity, url_filters

_MODULES = (decontaminate, exact_dedup, hard_negatives, language_id, license_scan, lm_scoring, mixing, phrases, pivot_search, simhash, suffix_dedup, toxicity, url_filters)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
