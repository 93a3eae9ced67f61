"""All queries of the core, and their SQL."""

from __future__ import annotations

from evidentia.plans import log_queries, orphan_queries, search_queries, service_queries, store_queries, text_queries, write_queries

_MODULES = [orphan_queries, store_queries, search_queries, text_queries, log_queries, service_queries, write_queries]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
