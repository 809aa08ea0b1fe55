"""DuckDB oracles for :mod:`sequences`."""

from __future__ import annotations

S = """WITH s AS (SELECT user_id AS item_id, event_type AS t,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
       count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


def sql() -> dict[str, str]:
    return {
        "node_stream_seq": S + "SELECT item_id, pos, t AS node_type, 0 AS depth FROM s",
        "shingles_k3": S + """,
k AS (SELECT item_id, pos, n, t || ' ' || lead(t, 1) OVER w || ' ' || lead(t, 2) OVER w AS shingle
      FROM s WINDOW w AS (PARTITION BY item_id ORDER BY pos))
SELECT item_id, pos, shingle FROM k WHERE pos <= n - 3
UNION ALL
SELECT item_id, 0 AS pos, string_agg(t, ' ' ORDER BY pos) AS shingle FROM s WHERE n < 3 GROUP BY item_id""",
    }
