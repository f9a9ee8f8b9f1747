"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from lodestore.llm import langid, licenses, minhash, mixing, packing, periodic_runs, quality, simhash, spelling, substring_dedup, suffix_dedup, wavelet, winnow

MODULES = [substring_dedup, quality, wavelet, licenses, suffix_dedup, winnow, packing, langid, mixing, simhash, minhash, spelling, periodic_runs]

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in MODULES for k, f in getattr(m, "ORACLE", {}).items()}
