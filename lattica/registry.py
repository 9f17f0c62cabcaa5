"""Named queries over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from lattica.plans import concept_queries, graph_queries, resolve_queries, source_queries, span_queries, state_queries, text_queries

_MODULES = (text_queries, graph_queries, span_queries, resolve_queries, source_queries, state_queries, concept_queries)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
