"""DuckDB SQL oracles: the same answers stated independently in plain SQL.

Fragments are CTE builders; each query key composes them. They use window
functions over exploded token lists instead of the engine's in-row folds, and
brute-force cross joins instead of candidate generation, so they check the
engine rather than restate it.
"""

from __future__ import annotations

from ..config import HTML, HTML_VOID_TAGS, LanguageProfile
from ..functions.text import HTML_NOISE
from ..operators.nodes import TAG_NAME_RE, TAG_RE, WORD_RE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


def case_map(col: str, mapping: dict[str, str]) -> str:
    if not mapping:
        return "NULL::VARCHAR"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


BLANK_CLASS = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def html_tags_cte(prefix: str = "h") -> str:
    """{p}_tags(item_id, pos, name, is_close, delta) over pages."""
    p = prefix
    return f"""
{p}_src AS (SELECT page_id AS item_id,
       regexp_extract_all(regexp_replace(html, {q(HTML_NOISE)}, '', 'g'), {q(TAG_RE)}, 0) AS toks FROM pages),
{p}_tok AS (SELECT item_id, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM {p}_src),
{p}_tags AS (SELECT item_id, pos::INTEGER AS pos, lower(regexp_extract(tok, {q(TAG_NAME_RE)}, 1)) AS name,
       starts_with(tok, '</') AS is_close,
       CASE WHEN starts_with(tok, '</') THEN -1
            WHEN lower(regexp_extract(tok, {q(TAG_NAME_RE)}, 1)) IN {in_list(HTML_VOID_TAGS)} OR ends_with(tok, '/>') THEN 0
            ELSE 1 END AS delta
     FROM {p}_tok)"""


def html_struct_cte(profile: LanguageProfile = HTML, prefix: str = "h") -> str:
    """{p}_struct(item_id, language, features, normalized, patterns) for every page."""
    p = prefix
    n2p = profile.node_to_pattern()
    pat = case_map("name", n2p)
    structural = f"name IN {in_list(profile.structural_nodes)}"
    return html_tags_cte(p) + f""",
{p}_cls AS (SELECT *, {pat} AS pat, {structural} AS structural FROM {p}_tags),
{p}_dep AS (SELECT *,
       coalesce(sum(delta) OVER w, 0)::INTEGER AS depth,
       coalesce(sum(CASE WHEN pat IS NOT NULL THEN delta ELSE 0 END) OVER w, 0)::INTEGER AS cdepth
     FROM {p}_cls
     WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}_min AS (SELECT *,
       min(CASE WHEN NOT is_close AND structural THEN depth END) OVER (PARTITION BY item_id) AS mind,
       min(CASE WHEN NOT is_close AND pat IS NOT NULL THEN cdepth END) OVER (PARTITION BY item_id) AS minc
     FROM {p}_dep),
{p}_agg AS (SELECT item_id,
       list(name || ':d' || depth::VARCHAR ORDER BY pos) FILTER (WHERE NOT is_close AND structural) AS features,
       list(coalesce(pat, name) || ':d' || (depth - mind)::VARCHAR ORDER BY pos) FILTER (WHERE NOT is_close AND structural) AS normalized,
       list(pat || ':d' || (cdepth - minc)::VARCHAR ORDER BY pos) FILTER (WHERE NOT is_close AND pat IS NOT NULL) AS patterns
     FROM {p}_min GROUP BY item_id),
{p}_struct AS (SELECT pg.page_id AS item_id, 'html' AS language,
       coalesce(a.features, []::VARCHAR[]) AS features,
       coalesce(a.normalized, []::VARCHAR[]) AS normalized,
       coalesce(a.patterns, []::VARCHAR[]) AS patterns
     FROM pages pg LEFT JOIN {p}_agg a ON a.item_id = pg.page_id)"""


def text_struct_cte(table: str, id_col: str, text_col: str, prefix: str, extra: str = "") -> str:
    """{p}_struct(item_id, language, features, normalized, patterns) for a text column."""
    p = prefix
    words = f"regexp_extract_all(lower({text_col}), {q(WORD_RE)}, 0)"
    return f"""
{p}_struct AS (SELECT {id_col} AS item_id, 'text' AS language{extra},
       list_transform({words}, lambda w: w || ':d0') AS features,
       list_transform({words}, lambda w: w || ':d0') AS normalized,
       list_transform({words}, lambda w: w || ':d0') AS patterns
     FROM {table})"""


def shingle_expr(lst: str, k: str, empty: str = "[]::VARCHAR[]") -> str:
    return (f"CASE WHEN len({lst}) = 0 THEN {empty} "
            f"WHEN len({lst}) < {k} THEN [array_to_string({lst}, ' ')] "
            f"ELSE list_transform(range(0, len({lst}) - {k} + 1), lambda i: array_to_string({lst}[i + 1 : i + {k}], ' ')) END")


def adaptive_k_expr(lst: str) -> str:
    return f"(CASE WHEN len({lst}) <= 5 THEN 2 WHEN len({lst}) <= 15 THEN 3 ELSE 4 END)"


def hash_expr(sh: str) -> str:
    return (f"CASE WHEN len({sh}) = 0 THEN repeat('00', 32) ELSE array_to_string(list_transform(range(0, 32), "
            f"lambda j: substr(sha256('salt' || j::VARCHAR || array_to_string({sh}, '')), 1, 2)), '') END")


def pset_expr(p: str) -> str:
    return f"list_sort(list_distinct({shingle_expr(p, '2')}))"


def fp_cte(src: str, out: str) -> str:
    """{out}(<src cols>, k, shingles, hash_hex, pset) from a struct CTE."""
    return f"""
{out}_k AS (SELECT *, {adaptive_k_expr('normalized')} AS k FROM {src}),
{out}_s AS (SELECT *, {shingle_expr('normalized', 'k')} AS shingles FROM {out}_k),
{out} AS (SELECT *, {hash_expr('shingles')} AS hash_hex, {pset_expr('patterns')} AS pset FROM {out}_s)"""


def words_expr(h: str, j: int) -> str:
    return f"('0x' || substr({h}, {16 * j + 1}, 16))::UBIGINT"


def hamming_expr(ha: str, hb: str) -> str:
    return "(" + " + ".join(f"bit_count(xor({words_expr(ha, j)}, {words_expr(hb, j)}))::INTEGER" for j in range(4)) + ")::INTEGER"


def inter_expr(a: str, b: str) -> str:
    """Intersection size of two distinct-element lists."""
    return f"len(list_intersect({a}, {b}))::BIGINT"


def union_expr(a: str, b: str) -> str:
    return f"(len({a}) + len({b}) - {inter_expr(a, b)})::BIGINT"


def verdict_select(a: str, b: str, hi: float = 0.80, med: float = 0.60, flag: float = 0.60) -> str:
    """D9 columns from two fingerprint aliases a, b (patterns, pset, hash_hex, language)."""
    dist = hamming_expr(f"{a}.hash_hex", f"{b}.hash_hex")
    syn = f"(1.0 - {dist}::DOUBLE / 256.0)"
    i, u = inter_expr(f"{a}.pset", f"{b}.pset"), union_expr(f"{a}.pset", f"{b}.pset")
    ea, eb = f"len({a}.patterns) = 0", f"len({b}.patterns) = 0"
    struct = f"(CASE WHEN {ea} AND {eb} THEN 1.0 WHEN {ea} OR {eb} THEN 0.0 ELSE {i}::DOUBLE / {u}::DOUBLE END)"
    best = f"greatest({syn}, {struct})"
    return f"""{best} AS similarity,
       ({best} > {flag} OR {struct} > {flag}) AS plagiarism_detected,
       CASE WHEN {struct} >= {hi} OR {best} >= 0.9 THEN 'high'
            WHEN {struct} >= {med} OR {best} >= 0.75 THEN 'medium' ELSE 'low' END AS confidence,
       {syn} AS syntactic_similarity,
       {dist} AS hamming_distance,
       {struct} AS structural_similarity,
       CASE WHEN {ea} OR {eb} THEN []::VARCHAR[] ELSE list_sort(list_intersect({a}.pset, {b}.pset)) END AS matching_patterns,
       CASE WHEN {ea} OR {eb} THEN '0/0' ELSE {i}::VARCHAR || '/' || {u}::VARCHAR END AS pattern_match_ratio,
       {a}.language AS lang1, {b}.language AS lang2,
       CASE WHEN {syn} >= {struct} THEN 'syntactic' ELSE 'structural' END AS method_used"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


def sig_pairs_sql(ctes: tuple[str, ...], fp: str, t: float, syn_t: float | None = None) -> str:
    """Grouped all-pairs (see operators.pairs.all_pairs) over fingerprint CTE ``fp``; result CTE ``ap``."""
    syn_t = t if syn_t is None else syn_t
    return with_(*ctes, f"""
sig AS (SELECT language, hash_hex, pset, min(item_id) AS rep, count(*) AS n, any_value(patterns) AS patterns
     FROM {fp} GROUP BY language, hash_hex, pset),
cls AS (SELECT pset, min(rep) AS crep, sum(n) AS tot, sum(n * n) AS sq, count(*) AS nsig,
       min(language) AS l1, max(language) AS l2 FROM sig GROUP BY pset),
pr AS (SELECT 'pair' AS kind, a.rep AS item_a, b.rep AS item_b, a.n AS n_a, b.n AS n_b, (a.n * b.n)::BIGINT AS n_pairs,
       {verdict_select('a', 'b')}
     FROM sig a JOIN sig b ON a.rep < b.rep WHERE a.pset <> b.pset),
wi AS (SELECT 'within' AS kind, rep AS item_a, rep AS item_b, n AS n_a, n AS n_b, (n * (n - 1) // 2)::BIGINT AS n_pairs,
       1.0 AS similarity, true AS plagiarism_detected, 'high' AS confidence, 1.0 AS syntactic_similarity,
       0 AS hamming_distance, 1.0 AS structural_similarity, pset AS matching_patterns,
       CASE WHEN len(pset) = 0 THEN '0/0' ELSE len(pset)::VARCHAR || '/' || len(pset)::VARCHAR END AS pattern_match_ratio,
       language AS lang1, language AS lang2, 'syntactic' AS method_used FROM sig WHERE n >= 2),
sp AS (SELECT 'same_patterns' AS kind, crep AS item_a, crep AS item_b, tot::BIGINT AS n_a, tot::BIGINT AS n_b,
       ((tot * tot - sq) // 2)::BIGINT AS n_pairs, 1.0 AS similarity, true AS plagiarism_detected,
       'high' AS confidence, NULL::DOUBLE AS syntactic_similarity, NULL::INTEGER AS hamming_distance,
       1.0 AS structural_similarity, pset AS matching_patterns,
       CASE WHEN len(pset) = 0 THEN '0/0' ELSE len(pset)::VARCHAR || '/' || len(pset)::VARCHAR END AS pattern_match_ratio,
       l1 AS lang1, l2 AS lang2, 'structural' AS method_used FROM cls WHERE nsig >= 2),
ap AS (SELECT * FROM pr WHERE structural_similarity >= {t} OR syntactic_similarity >= {syn_t}
     UNION ALL SELECT * FROM wi UNION ALL SELECT * FROM sp)""")
