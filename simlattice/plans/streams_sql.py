"""DuckDB oracles for :mod:`streams` (the final tables equal the batch answers)."""

from __future__ import annotations


def sql() -> dict[str, str]:
    from .pages_sql import sql as pages_sql
    return {
        "stream_search": pages_sql()["search_combined"],
        "stream_dedupe": """SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    }
