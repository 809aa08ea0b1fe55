"""DuckDB oracles for rendered programs: the answer stated from ``lineitem``."""

from __future__ import annotations

from . import programs as P
from .oracle_sql import (adaptive_k_expr, hash_expr, inter_expr, pset_expr, shingle_expr, union_expr, verdict_select,
                         with_)

LI = """
li AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'LOOP' ELSE 'COND' END AS kind, l_linestatus AS ls,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                          CASE WHEN l_returnflag = 'R' THEN 'LOOP' ELSE 'COND' END) - 1 AS i,
       count(*) OVER (PARTITION BY l_orderkey) AS n
     FROM lineitem),
lg AS (SELECT * FROM (VALUES ('python'), ('java'), ('cpp')) t(language))"""

NESTED = """
nested AS (SELECT l_orderkey, list(kind || ':d' || (i % 3)::VARCHAR ORDER BY i) AS patterns FROM li GROUP BY l_orderkey),
nested_l AS (SELECT n.l_orderkey, lg.language, n.patterns, n.patterns AS normalized FROM nested n, lg)"""

CHAIN = """
ch AS (SELECT *, (kind = 'COND' AND i > 0 AND lag(kind) OVER w = 'COND') AS cont,
              (kind = 'COND' AND (i = n - 1 OR lead(kind) OVER w <> 'COND')) AS last
     FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
ch_rows AS (SELECT l_orderkey, i, 0 AS sub, kind, cont, 0 AS nested FROM ch
     UNION ALL SELECT l_orderkey, i, 1 AS sub, 'COND' AS kind, false AS cont, 1 AS nested FROM ch WHERE last AND ls = 'O'),
chain_l AS (SELECT r.l_orderkey, lg.language,
       list(r.kind || ':d' || (CASE WHEN r.nested = 1 AND lg.language = 'java' THEN 1 ELSE 0 END)::VARCHAR
            ORDER BY r.i, r.sub) AS patterns,
       list(r.kind || ':d' || r.nested::VARCHAR ORDER BY r.i, r.sub)
            FILTER (WHERE lg.language <> 'python' OR NOT r.cont) AS normalized
     FROM ch_rows r, lg GROUP BY r.l_orderkey, lg.language)"""


def _fp(src: str) -> str:
    return f"""
fpk AS (SELECT l_orderkey, language, patterns, coalesce(normalized, []::VARCHAR[]) AS normalized FROM {src}),
fps AS MATERIALIZED (SELECT *, {shingle_expr('normalized', adaptive_k_expr('normalized'))} AS shingles,
       {pset_expr('patterns')} AS pset FROM fpk),
digest AS MATERIALIZED (SELECT shingles, {hash_expr('shingles')} AS hash_hex FROM (SELECT DISTINCT shingles FROM fps)),
fp AS MATERIALIZED (SELECT fps.*, hash_hex FROM fps JOIN digest USING (shingles)),
pairs AS (SELECT a.l_orderkey, {{verdict}} FROM fp a JOIN fp b ON a.l_orderkey = b.l_orderkey AND a.language < b.language)"""


#: What the verdict rests on.
DEBUG = """, a.patterns AS patterns1, b.patterns AS patterns2,
       CASE WHEN len(a.patterns) > 0 AND len(b.patterns) > 0 THEN a.pset END AS shingles1,
       CASE WHEN len(a.patterns) > 0 AND len(b.patterns) > 0 THEN b.pset END AS shingles2,
       CASE WHEN len(a.patterns) > 0 AND len(b.patterns) > 0 THEN list_sort(list_intersect(a.pset, b.pset)) END AS intersection"""


def _pairs(shape: str, more: str = "", **cfg) -> str:
    src = "nested_l" if shape == "nested" else "chain_l"
    body = NESTED if shape == "nested" else CHAIN
    return with_(LI, body, _fp(src).replace("{verdict}", verdict_select("a", "b", **cfg) + more))


VCOLS = ", ".join(P.VERDICT_COLS)


def sql() -> dict[str, str]:
    strict = dict(hi=P.STRICT.high_confidence_threshold, med=P.STRICT.medium_confidence_threshold,
                  flag=P.STRICT.plagiarism_threshold)
    sweep = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE similarity > {t} OR structural_similarity > {t})::BIGINT "
        f"AS n_flagged FROM pairs" for t in P.SWEEP)
    langs = sorted(("python", "java", "cpp"))
    piv = ", ".join(f"max(CASE WHEN other = '{x}' THEN similarity END) AS {x}" for x in langs)
    return {
        "control_flow_python": with_(LI, NESTED) + "SELECT l_orderkey, patterns FROM nested",
        "control_flow_brace": with_(LI, NESTED) + "SELECT l_orderkey, language, patterns FROM nested_l "
                                                  "WHERE language IN ('java', 'cpp')",
        "strip_noise": with_(LI, NESTED) + "SELECT l_orderkey, language, patterns FROM nested_l",
        "else_if_chain": with_(LI, CHAIN) + "SELECT l_orderkey, language, patterns FROM chain_l",
        "compare_pairs": _pairs("nested", DEBUG) + f"""SELECT l_orderkey, {VCOLS}, patterns1, patterns2, shingles1, shingles2,
       intersection FROM pairs""",
        "cross_language_search": _pairs("chain") + f""",
cls AS (SELECT language, pset, min(l_orderkey * 4 + list_position(['python', 'java', 'cpp'], language) - 1) AS k,
       count(*) AS n FROM fp WHERE len(pset) > 0 GROUP BY language, pset),
sc AS (SELECT a.language AS lang1, b.language AS lang2, a.k AS item_a, b.k AS item_b, a.n AS n_a, b.n AS n_b,
       a.n * b.n AS n_pairs, {inter_expr('a.pset', 'b.pset')}::DOUBLE / {union_expr('a.pset', 'b.pset')}::DOUBLE AS structural_similarity,
       list_sort(list_intersect(a.pset, b.pset)) AS matching_patterns
     FROM cls a JOIN cls b ON a.language < b.language)
SELECT * FROM sc WHERE structural_similarity >= {P.CROSS_T}""",
        "cross_language_pairs": _pairs("chain") + f"SELECT l_orderkey, {VCOLS} FROM pairs",
        "similarity_matrix": _pairs("chain") + f""",
lng AS (SELECT l_orderkey, lang1 AS name, lang2 AS other, similarity FROM pairs
     UNION ALL SELECT l_orderkey, lang2, lang1, similarity FROM pairs
     UNION ALL SELECT DISTINCT l_orderkey, x, x, 1.0 FROM (SELECT l_orderkey, lang1 AS x FROM pairs
                                                          UNION SELECT l_orderkey, lang2 FROM pairs))
SELECT l_orderkey, name, {piv} FROM lng GROUP BY l_orderkey, name""",
        "verdict": _pairs("chain") + "SELECT l_orderkey, lang1, lang2, similarity, method_used, confidence, "
                                     "plagiarism_detected FROM pairs",
        "verdict_strict": _pairs("chain", **strict) + "SELECT l_orderkey, lang1, lang2, similarity, method_used, "
                                                      "confidence, plagiarism_detected FROM pairs",
        "threshold_sweep": _pairs("chain") + sweep,
        "report_rows": _pairs("chain") + """SELECT l_orderkey::VARCHAR || '.' || lang1 AS file_1,
       l_orderkey::VARCHAR || '.' || lang2 AS file_2, printf('%.1f%%', similarity * 100) AS similarity,
       printf('%.1f%%', syntactic_similarity * 100) AS syntactic, printf('%.1f%%', structural_similarity * 100) AS structural,
       upper(confidence) AS confidence FROM pairs""",
    }
