"""DuckDB oracles for :mod:`store` queries."""

from __future__ import annotations

from ..config import PREVIEW_SEARCH, SYNTACTIC_T
from . import store as T
from .oracle_sql import fp_cte, text_struct_cte, with_
from .pages_sql import FP, H, _combined

#: The stored page bank: ids in the order of source and path.
BANK = """
bank AS (SELECT fp.*, row_number() OVER (ORDER BY source, file_path) - 1 AS id, source, file_path, html
     FROM (SELECT page_id, html, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS source,
             url || '#' || lpad(page_id::VARCHAR, 12, '0') AS file_path FROM pages) pg JOIN fp ON fp.item_id = pg.page_id)"""

DOCS = text_struct_cte("documents", "doc_id", "text", "d",
                       extra=", source, lang || '/doc_' || doc_id::VARCHAR || '.txt' AS file_path, length(text)::BIGINT AS size")
REVISED = text_struct_cte("(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))", "doc_id",
                          "text || ' revised'", "r", extra=", source, lang || '/doc_' || doc_id::VARCHAR || '.txt' AS file_path, "
                                                           "length(text || ' revised')::BIGINT AS size")
ITEMS = text_struct_cte("benchmark", "item_id", "text", "b",
                        extra=", 'benchmark' AS source, 'item_' || item_id::VARCHAR || '.txt' AS file_path, "
                              "length(text)::BIGINT AS size")


def sql() -> dict[str, str]:
    preview = (f"CASE WHEN length(b.html) > {PREVIEW_SEARCH} THEN substr(b.html, 1, {PREVIEW_SEARCH}) || '...' "
               "ELSE b.html END")
    return {
        "store_search": with_(H, FP, BANK, _combined(T.STRUCTURAL_T, T.SHOWN, SYNTACTIC_T)) + f"""
SELECT c.query_id, c.id, c.syntactic_similarity, c.structural_similarity, c.similarity, c.match_type, c.matching_patterns,
       b.source, b.file_path, b.language, {preview} AS preview, b.patterns,
       '{{"page":"' || b.item_id::VARCHAR || '"}}' AS metadata
FROM comb c JOIN bank b ON b.id = c.id""",
        "store_upsert": with_(DOCS, REVISED, ITEMS, fp_cte("d_struct", "dfp"), fp_cte("r_struct", "rfp"),
                              fp_cte("b_struct", "bfp"), """
old AS (SELECT *, row_number() OVER (ORDER BY source, file_path) - 1 AS id FROM dfp),
new AS (SELECT *, (SELECT count(*) FROM dfp) + row_number() OVER (ORDER BY source, file_path) - 1 AS id
     FROM (SELECT source, file_path, language, size, hash_hex FROM rfp
           UNION ALL SELECT source, file_path, language, size, hash_hex FROM bfp))""") + """
SELECT id, source, file_path, language, size, hash_hex, NULL::BIGINT AS replaced_id FROM old
WHERE (source, file_path) NOT IN (SELECT (source, file_path) FROM new)
UNION ALL
SELECT n.id, n.source, n.file_path, n.language, n.size, n.hash_hex, o.id
FROM new n LEFT JOIN old o ON o.source = n.source AND o.file_path = n.file_path""",
    }
