"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import decontamination, html_extraction, license_scan, ngram_join, packing, periodic_runs, prefix_trie, quality_rules, secret_scan, sharding, token_counts, toxicity, url_filter

MODULES = (toxicity, quality_rules, license_scan, token_counts, sharding, ngram_join, html_extraction, decontamination, secret_scan, packing, prefix_trie, url_filter, periodic_runs)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
