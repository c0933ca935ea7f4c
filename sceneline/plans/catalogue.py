"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from sceneline.plans import io_queries, media_queries, mining_queries, preflight_queries, report_queries, rescue_queries, resolution_queries, review_queries, script_queries, shot_queries, star_queries, text_queries

_PARTS = [shot_queries, text_queries, report_queries, review_queries, resolution_queries, script_queries, rescue_queries, io_queries, media_queries, mining_queries, preflight_queries, star_queries]
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
