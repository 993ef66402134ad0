"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from . import briefing_queries, desk_queries, event_queries, ingest_queries, intake_queries, ledger_queries, linkage_queries, review_queries, text_queries, upkeep_queries, verdict_queries

PAIRS = text_queries.PAIRS | event_queries.PAIRS | ingest_queries.PAIRS | linkage_queries.PAIRS | ledger_queries.PAIRS | review_queries.PAIRS | desk_queries.PAIRS | upkeep_queries.PAIRS | verdict_queries.PAIRS | intake_queries.PAIRS | briefing_queries.PAIRS


def queries() -> dict:
    return {name: query for name, (query, _) in PAIRS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in PAIRS.items() if sql}
