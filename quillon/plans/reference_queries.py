"""Queries of the engine's operators over whole tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from quillon.plans import entity_queries, event_queries, model_queries, model_sql, pipeline, report_queries, score_queries

_BOOKS = (event_queries.BOOK, entity_queries.BOOK, score_queries.BOOK, model_queries.BOOK, report_queries.BOOK)
QUERIES = {name: f for b in _BOOKS for name, f in b.queries.items()}
SQL = {name: s for b in _BOOKS for name, s in b.sql.items()}
SQL["discovery_candidates"] = model_sql.discovery_sql(model_queries.AS_OF, pipeline.DISCOVERY)
