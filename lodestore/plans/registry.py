"""All queries of the memory-bank engine with the SQL they are checked against."""

from __future__ import annotations

from lodestore.plans import analytics_queries, build_queries, index_queries, ingest_queries, layout_queries, retrieval_queries, store_queries, stream_queries, text_queries

MODULES = [retrieval_queries, text_queries, analytics_queries, layout_queries, store_queries, stream_queries, ingest_queries, index_queries, build_queries]
FLAGSHIP = "hybrid_topk"

QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in MODULES for k, f in m.ORACLE.items()}
