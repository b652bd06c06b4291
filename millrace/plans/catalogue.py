"""All registered queries with their SQL, gathered from the modules of millrace.plans."""

from __future__ import annotations

from . import detail_queries, graph_queries, keyword_queries, lake_queries, lookup_queries, pipeline_queries, policy_queries, record_queries, relational_queries, scalar_queries, store_queries, streaming_queries, text_queries, upsert_queries, vector_queries

MODULES = (relational_queries, upsert_queries, scalar_queries, text_queries, vector_queries, graph_queries, policy_queries, record_queries, pipeline_queries, streaming_queries, lake_queries, store_queries, detail_queries, keyword_queries, lookup_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
