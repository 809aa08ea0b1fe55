"""DuckDB oracles for :mod:`pages` queries."""

from __future__ import annotations

from ..config import DEFAULT_PROFILES, update_patterns
from . import pages as P
from .oracle_sql import (fp_cte, hamming_expr, html_struct_cte, html_tags_cte, inter_expr, shingle_expr,
                         adaptive_k_expr, sig_pairs_sql, union_expr, verdict_select, with_)

H = html_struct_cte()
FP = fp_cte("h_struct", "fp")
BANK = """
bank AS (SELECT fp.*, fp.item_id AS id, regexp_extract(pg.url, '^[A-Za-z]+://([^/?#]+)', 1) AS source,
       pg.url AS file_path FROM fp JOIN pages pg ON pg.page_id = fp.item_id)"""


def _tags():
    return with_(html_tags_cte("h"), """
h_dep AS (SELECT *, coalesce(sum(delta) OVER (PARTITION BY item_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS depth FROM h_tags)""") + \
        "SELECT item_id, pos, name AS node_type, depth FROM h_dep WHERE NOT is_close"


def _syn_hits(t: float, limit: int, name: str = "syn") -> str:
    return f"""
{name}_all AS (SELECT q.item_id AS query_id, b.id, {hamming_expr('q.hash_hex', 'b.hash_hex')} AS hamming_distance
     FROM fp q, bank b),
{name}_f AS (SELECT *, 1.0 - hamming_distance::DOUBLE / 256.0 AS similarity FROM {name}_all
     WHERE 1.0 - hamming_distance::DOUBLE / 256.0 >= {t}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn
     FROM {name}_f) WHERE rn <= {limit})"""


def _st_hits(t: float, limit: int, name: str = "st") -> str:
    i, u = inter_expr("q.pset", "b.pset"), union_expr("q.pset", "b.pset")
    return f"""
{name}_all AS (SELECT q.item_id AS query_id, b.id,
       CASE WHEN {u} = 0 THEN 0.0 ELSE {i}::DOUBLE / {u}::DOUBLE END AS similarity,
       list_sort(list_intersect(q.pset, b.pset)) AS matching_patterns
     FROM fp q, bank b WHERE len(b.patterns) > 0),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rn
     FROM {name}_all WHERE similarity >= {t}) WHERE rn <= {limit})"""


def _combined(t: float, limit: int, syn_t: float | None = None) -> str:
    return _syn_hits(t if syn_t is None else syn_t, 2 * limit) + "," + _st_hits(t, 2 * limit) + f""",
m AS (SELECT coalesce(syn.query_id, st.query_id) AS query_id, coalesce(syn.id, st.id) AS id,
       coalesce(syn.similarity, 0.0) AS syntactic_similarity, coalesce(st.similarity, 0.0) AS structural_similarity,
       CASE WHEN st.similarity IS NOT NULL AND (syn.similarity IS NULL OR st.similarity > syn.similarity)
            THEN st.similarity ELSE syn.similarity END AS similarity,
       CASE WHEN st.similarity IS NOT NULL AND (syn.similarity IS NULL OR st.similarity > syn.similarity)
            THEN 'structural' ELSE 'syntactic' END AS match_type,
       st.matching_patterns
     FROM syn FULL OUTER JOIN st ON syn.query_id = st.query_id AND syn.id = st.id),
comb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rk
     FROM m) WHERE rk <= {limit})"""


def _sig_pairs(t: float, syn_t: float | None = None) -> str:
    return sig_pairs_sql((H, FP), "fp", t, syn_t)


def _item_matrix() -> str:
    return with_(H, FP, BANK, f"""
chosen AS (SELECT item_id FROM (SELECT min(item_id) AS item_id, count(*) AS n FROM fp GROUP BY hash_hex)
     ORDER BY n DESC, item_id LIMIT {P.MATRIX_MAX_FILES}),
f AS (SELECT fp.*, left(bank.file_path, {P.MATRIX_NAME_CHARS}) AS name FROM fp JOIN chosen USING (item_id)
     JOIN bank ON bank.id = fp.item_id),
v AS (SELECT a.item_id AS item_a, b.item_id AS item_b, a.name AS name_a, b.name AS name_b, {verdict_select('a', 'b')}
     FROM f a, f b)""") + "SELECT item_a, item_b, name_a, name_b, CASE WHEN item_a = item_b THEN 1.0 ELSE similarity END AS similarity FROM v"


def _custom():
    prof = update_patterns(DEFAULT_PROFILES, "html", P.CUSTOM_HTML_PATTERNS)["html"]
    return with_(html_struct_cte(prof, "c")) + "SELECT item_id, normalized, patterns FROM c_struct"


def sql() -> dict[str, str]:
    t = P.ALL_PAIRS_T
    i, u = inter_expr("a.pset", "b.pset"), union_expr("a.pset", "b.pset")
    return {
        "node_stream_html": _tags(),
        "features_html": with_(H) + "SELECT item_id, features FROM h_struct",
        "normalize_features": with_(H) + "SELECT item_id, normalized FROM h_struct",
        "debug_patterns": with_(H) + "SELECT item_id, features, normalized, patterns AS control_flow FROM h_struct",
        "shingles_k2": with_(H) + f"SELECT item_id, {shingle_expr('patterns', '2', empty="['empty']")} AS shingles FROM h_struct",
        "shingles_adaptive": with_(H) + f"SELECT item_id, {adaptive_k_expr('normalized')} AS k, "
                                        f"{shingle_expr('normalized', adaptive_k_expr('normalized'))} AS shingles FROM h_struct",
        "fingerprint": with_(H, FP) + "SELECT item_id, hash_hex, patterns, shingles FROM fp",
        "fingerprint_groups": with_(H, FP) + "SELECT hash_hex, count(*) AS n_items, min(item_id) AS first_item, "
                                             "max(item_id) AS last_item FROM fp GROUP BY hash_hex HAVING count(*) > 1",
        "hamming_pairs": with_(H, FP, f"""
sig AS (SELECT hash_hex, min(item_id) AS rep, count(*) AS n FROM fp GROUP BY hash_hex),
pr AS (SELECT 'pair' AS kind, a.rep AS item_a, b.rep AS item_b, a.n AS n_a, b.n AS n_b, (a.n * b.n)::BIGINT AS n_pairs,
       {hamming_expr('a.hash_hex', 'b.hash_hex')} AS hamming_distance FROM sig a JOIN sig b ON a.rep < b.rep),
al AS (SELECT * FROM pr WHERE hamming_distance <= {int(256 * (1 - P.HAMMING_T) + 1e-9)}
       UNION ALL SELECT 'within', rep, rep, n, n, (n * (n - 1) // 2)::BIGINT, 0 FROM sig WHERE n >= 2)""") +
            "SELECT *, 1.0 - hamming_distance::DOUBLE / 256.0 AS syntactic_similarity FROM al",
        "jaccard_pairs": with_(H, FP, f"""
sig AS (SELECT pset, min(item_id) AS rep, count(*) AS n FROM fp GROUP BY pset),
pr AS (SELECT 'pair' AS kind, a.rep AS item_a, b.rep AS item_b, a.n AS n_a, b.n AS n_b, (a.n * b.n)::BIGINT AS n_pairs,
       CASE WHEN len(a.pset) = 0 AND len(b.pset) = 0 THEN 1.0 WHEN len(a.pset) = 0 OR len(b.pset) = 0 THEN 0.0
            ELSE {i}::DOUBLE / {u}::DOUBLE END AS structural_similarity,
       CASE WHEN len(a.pset) = 0 OR len(b.pset) = 0 THEN []::VARCHAR[]
            ELSE list_sort(list_intersect(a.pset, b.pset)) END AS matching_patterns,
       CASE WHEN len(a.pset) = 0 OR len(b.pset) = 0 THEN '0/0' ELSE {i}::VARCHAR || '/' || {u}::VARCHAR END AS pattern_match_ratio
     FROM sig a JOIN sig b ON a.rep < b.rep)""") + f"""
SELECT * FROM pr WHERE structural_similarity >= {P.JACCARD_T}
UNION ALL SELECT 'within', rep, rep, n, n, (n * (n - 1) // 2)::BIGINT, 1.0, pset,
       CASE WHEN len(pset) = 0 THEN '0/0' ELSE len(pset)::VARCHAR || '/' || len(pset)::VARCHAR END FROM sig WHERE n >= 2""",
        "all_pairs": _sig_pairs(t) + "SELECT * FROM ap",
        "all_pairs_default": _sig_pairs(P.DEFAULT_PAIRS_T, P.DEFAULT_SYN_T) + "SELECT * FROM ap",
        "item_matrix": _item_matrix(),
        "search_combined_default": with_(H, FP, BANK, _combined(P.SEARCH_STRUCT_T, P.SEARCH_LIMIT, P.DEFAULT_SYN_T)) +
            "SELECT c.query_id, c.id, c.syntactic_similarity, c.structural_similarity, c.similarity, c.match_type, "
            "c.matching_patterns, b.source, b.file_path, b.language FROM comb c JOIN bank b ON b.id = c.id",
        "pair_count": _sig_pairs(t) + "SELECT sum(n_pairs)::BIGINT AS n_pairs FROM ap",
        "pair_budget": "SELECT count(*) AS n_items, (count(*) * (count(*) - 1) // 2)::BIGINT AS n_pairs FROM pages",
        "custom_patterns": _custom(),
        "search_syntactic": with_(H, FP, BANK, _syn_hits(P.SEARCH_SYN_T, P.SEARCH_LIMIT)) +
            "SELECT s.query_id, s.id, s.similarity, s.hamming_distance, 'syntactic' AS match_type, "
            "b.source, b.file_path, b.language FROM syn s JOIN bank b ON b.id = s.id",
        "search_structural": with_(H, FP, BANK, _st_hits(P.SEARCH_STRUCT_T, P.SEARCH_LIMIT)) +
            "SELECT s.query_id, s.id, s.similarity, s.matching_patterns, 'structural' AS match_type, "
            "b.source, b.file_path, b.language FROM st s JOIN bank b ON b.id = s.id",
        "search_combined": with_(H, FP, BANK, _combined(P.SEARCH_SYN_T, P.SEARCH_LIMIT)) +
            "SELECT c.query_id, c.id, c.syntactic_similarity, c.structural_similarity, c.similarity, c.match_type, "
            "c.matching_patterns, b.source, b.file_path, b.language FROM comb c JOIN bank b ON b.id = c.id",
        "search_combined_true": with_(H, FP, BANK, _combined(P.SEARCH_SYN_T, P.SEARCH_LIMIT)) + f"""
SELECT c.query_id, c.id, c.similarity, c.match_type, c.matching_patterns,
       1.0 - {hamming_expr('q.hash_hex', 'b.hash_hex')}::DOUBLE / 256.0 AS syntactic_similarity,
       CASE WHEN len(b.patterns) = 0 OR {union_expr('q.pset', 'b.pset')} = 0 THEN 0.0
            ELSE {inter_expr('q.pset', 'b.pset')}::DOUBLE / {union_expr('q.pset', 'b.pset')}::DOUBLE END AS structural_similarity
FROM comb c JOIN fp q ON q.item_id = c.query_id JOIN bank b ON b.id = c.id""",
        "top_k_per_query": with_(H, FP, BANK, _combined(P.SEARCH_SYN_T, P.SEARCH_LIMIT)) +
            "SELECT query_id, id, similarity, match_type, rk AS rank, "
            "CASE WHEN similarity >= 0.8 THEN 'HIGH' WHEN similarity >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS badge "
            f"FROM comb WHERE rk <= {P.SHOWN}",
        "badge": with_(H, FP, BANK, _st_hits(P.SEARCH_STRUCT_T, P.SEARCH_LIMIT)) +
            "SELECT query_id, id, similarity, "
            "CASE WHEN similarity >= 0.8 THEN 'HIGH' WHEN similarity >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS badge FROM st",
    }
