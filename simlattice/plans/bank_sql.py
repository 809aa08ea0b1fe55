"""DuckDB oracles for :mod:`bank` queries."""

from __future__ import annotations

from ..config import BANK_EXTENSIONS, DEFAULT_PROFILES, DETECT_EXTENSIONS, UPLOAD_EXTENSIONS
from ..operators.structure import BLANK_RE
from . import bank as B
from .oracle_sql import case_map, fp_cte, q, sig_pairs_sql, text_struct_cte, with_

D = text_struct_cte("documents", "doc_id", "text", "d", extra=", lang, source, length(text)::BIGINT AS size")
DFP = fp_cte("d_struct", "dfp")
DBANK = """
dbank AS (SELECT item_id AS id, source, lang || '/doc_' || item_id::VARCHAR || '.txt' AS file_path, lang AS language,
       size, hash_hex, patterns, pset FROM dfp)"""
BASIC = "id, source, file_path, language, size"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1)"


def _ext(path: str) -> str:
    name = f"regexp_extract({path}, '([^/\\\\]*)$', 1)"
    return f"lower(regexp_extract({name}, '(\\.[^.]*)$', 1))"


def _bits(h: str) -> str:
    per = f"list_transform(range(0, 32), lambda i: lpad(bin(('0x' || substr({h}, 2 * i + 1, 2))::INTEGER), 8, '0'))"
    return f"array_to_string(string_split(array_to_string({per}, ''), ''), ',')"


def sql() -> dict[str, str]:
    ext = _ext(PATH)
    extra = {e: p.name for p in DEFAULT_PROFILES.values() for e in p.extensions if e not in UPLOAD_EXTENSIONS}
    rel = f"regexp_replace({PATH}, '^/+', '')"
    conv = text_struct_cte("conversations", "conv_id * 1000 + turn", "text", "c",
                           extra=", conv_id, turn, length(text)::BIGINT AS size")
    bm = text_struct_cte("benchmark", "item_id", "text", "b",
                         extra=", 'item_' || item_id::VARCHAR || '.txt' AS file_path, length(text)::BIGINT AS size")
    preview = lambda n: f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END"
    return {
        "bank_scan": with_(D, DFP, DBANK) + f"SELECT {BASIC}, hash_hex, len(patterns)::BIGINT AS n_patterns FROM dbank",
        "bank_reload": "SELECT count(*) AS n_loaded, count(*) AS n_written, count(*) AS n_kept FROM documents",
        "detect_language": f"""SELECT page_id, {ext} AS ext, {case_map(ext, DETECT_EXTENSIONS)} AS lang_detect,
       coalesce({case_map(ext, UPLOAD_EXTENSIONS)}, {case_map(ext, extra)}, 'python') AS lang_upload,
       {case_map(ext, BANK_EXTENSIONS)} AS lang_bank FROM pages""",
        "provenance": f"""SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) AS source, {rel} AS file_path,
       string_split({rel}, '/')[-1] AS filename,
       CASE WHEN len(string_split({rel}, '/')) > 1
            THEN array_to_string(string_split({rel}, '/')[1:len(string_split({rel}, '/')) - 1], '/') ELSE '.' END AS folder,
       CASE WHEN len(string_split({rel}, '/')) > 1
            THEN array_to_string(string_split({rel}, '/')[1:len(string_split({rel}, '/')) - 1], '/') ELSE '' END AS category,
       length(html)::BIGINT AS size FROM pages""",
        "filter_bank": with_(D, DFP, DBANK) + f"SELECT {BASIC} FROM dbank WHERE source = {q(B.FILTER_SOURCE)} "
                                              f"AND language = {q(B.FILTER_LANGUAGE)}",
        "browse_bank": with_(D, DFP, DBANK) + f"SELECT {BASIC} FROM dbank WHERE language = {q(B.BROWSE_LANGUAGE)} "
                                              f"AND file_path ILIKE {q('%' + B.BROWSE_TERM + '%')} ORDER BY id LIMIT 50",
        "blank_items": with_(D) + f"""SELECT doc_id AS item_id, NOT regexp_matches(coalesce(text, ''), {q(BLANK_RE)}) AS is_blank,
       len(s.patterns)::BIGINT AS n_nodes FROM documents JOIN d_struct s ON s.item_id = doc_id""",
        "preview": f"SELECT doc_id AS id, {preview(2000)} AS preview_browse, {preview(800)} AS preview_search, "
                   f"{preview(500)} AS preview_add FROM documents",
        "get_item": with_(D, DFP, DBANK) + f"SELECT {BASIC}, hash_hex, quality, toxic FROM dbank JOIN labels l ON l.doc_id = id",
        "codec_roundtrip": with_(D, DFP, DBANK) + f"""SELECT id, {_bits('hash_hex')} AS hash_value,
       length(array_to_string(patterns, '|'))::BIGINT AS patterns_chars, NULL::VARCHAR AS metadata_json,
       true AS roundtrip_ok FROM dbank""",
        "bank_upsert": with_(D, DFP, DBANK, conv, fp_cte("c_struct", "cfp")) + f"""
SELECT {BASIC}, hash_hex FROM dbank
UNION ALL
SELECT item_id, 'conversations', 'conv_' || conv_id::VARCHAR || '.txt', 'text', size, hash_hex
FROM cfp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, item_id DESC) = 1""",
        "bank_append": with_(D, DFP, DBANK, bm, fp_cte("b_struct", "bfp")) + """
SELECT (SELECT max(id) FROM dbank) + item_id + 1 AS id, 'benchmark' AS source, file_path, 'text' AS language, size,
       hash_hex, 'upload' AS added_via FROM bfp""",
        "bank_stats": with_(D, DFP, DBANK) + """
SELECT 'total' AS dimension, NULL::VARCHAR AS key, count(*)::BIGINT AS n FROM dbank
UNION ALL SELECT 'language', language, count(*)::BIGINT FROM dbank GROUP BY language
UNION ALL SELECT 'source', source, count(*)::BIGINT FROM dbank GROUP BY source""",
        "bank_cardinality": with_(D, DFP, DBANK) + "SELECT count(*) AS n_items, count(DISTINCT language) AS n_languages, "
                                                   "count(DISTINCT source) AS n_sources FROM dbank",
        "all_pairs_documents": sig_pairs_sql((D, DFP), "dfp", B.NEAR_COPY_T) + "SELECT * FROM ap",
        "search_benchmark": with_(D, DFP, DBANK, bm, fp_cte("b_struct", "bfp")) + f"""
, st AS (SELECT q.item_id AS query_id, b.id,
       CASE WHEN len(list_union) = 0 THEN 0.0 ELSE len(list_inter)::DOUBLE / len(list_union)::DOUBLE END AS similarity,
       list_sort(list_inter) AS matching_patterns, b.source, b.file_path, b.language
     FROM (SELECT q.item_id, b.id, list_intersect(q.pset, b.pset) AS list_inter,
                  list_distinct(list_concat(q.pset, b.pset)) AS list_union
           FROM bfp q, dbank b WHERE len(b.patterns) > 0) x
     JOIN bfp q ON q.item_id = x.item_id JOIN dbank b ON b.id = x.id)
SELECT query_id, id, similarity, matching_patterns, 'structural' AS match_type, source, file_path, language
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn FROM st
      WHERE similarity >= {B.PASSAGE_T}) WHERE rn <= 100""",
    }
