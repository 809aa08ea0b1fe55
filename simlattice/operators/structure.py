"""Items -> structure arrays -> fingerprints, in one narrow projection.

Every item is one row and its structure is computed inside that row (a fold
over its own tokens), so fingerprinting a bank is a map-only stage: no shuffle,
no Python, and the cost grows linearly with the number of items.
"""

from __future__ import annotations

from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_PROFILES, HTML_VOID_TAGS, DetectorConfig, LanguageProfile
from ..functions import codefold
from ..functions import controlflow as cf
from ..functions.fingerprint import fingerprint_hex, hash_word
from ..functions.shingles import adaptive_shingles, pattern_set
from ..functions.text import strip_noise
from ..functions.util import chunked_aggregate, let
from .nodes import TAG_NAME_RE, TAG_RE, WORD_RE

# Whitespace per Unicode (what str.strip removes), valid in Java and RE2.
BLANK_RE = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def html_structure(code: Column, profile: LanguageProfile) -> Column:
    """Tag-tree fold: features use tree depth, patterns use control depth."""
    n2p = profile.node_to_pattern()
    pmap = F.create_map(*[v for k, p in n2p.items() for v in (F.lit(k), F.lit(p))]) if n2p else None
    toks = F.regexp_extract_all(strip_noise(code, "html"), F.lit(TAG_RE), 0)

    def info(t: Column) -> Column:
        name = F.lower(F.regexp_extract(t, TAG_NAME_RE, 1))
        close = t.startswith("</")
        void = name.isin(*HTML_VOID_TAGS) | t.endswith("/>")
        delta = F.when(close, -1).when(void, 0).otherwise(1)
        pat = F.try_element_at(pmap, name) if pmap is not None else F.lit(None).cast("string")
        return F.struct(name.alias("name"), close.alias("close"), delta.alias("delta"),
                        F.when(pat.isNotNull(), delta).otherwise(0).alias("cdelta"),
                        name.isin(*profile.structural_nodes).alias("structural"),
                        pat.alias("pat"))

    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("cd"),
                    F.array().cast(cf.ND_ARRAY).alias("feats"), F.array().cast(cf.ND_ARRAY).alias("pats"))

    def step(acc: Column, x: Column) -> Column:
        is_open = ~x["close"]
        feats = F.when(is_open & x["structural"],
                       F.concat(acc["feats"], F.array(cf._nd(x["name"], acc["d"])))).otherwise(acc["feats"])
        pats = F.when(is_open & x["pat"].isNotNull(),
                      F.concat(acc["pats"], F.array(cf._nd(x["pat"], acc["cd"])))).otherwise(acc["pats"])
        return F.struct((acc["d"] + x["delta"]).alias("d"), (acc["cd"] + x["cdelta"]).alias("cd"),
                        feats.alias("feats"), pats.alias("pats"))

    folded = chunked_aggregate(F.transform(toks, info), init, step, ("d", "cd", "feats", "pats"), ("feats", "pats"), cf.ND_ARRAY)
    return let(folded, lambda r: F.struct(r["pats"].alias("patterns"), r["feats"].alias("features")))


def text_structure(code: Column) -> Column:
    words = F.regexp_extract_all(F.lower(code), F.lit(WORD_RE), 0)
    nd = F.transform(words, lambda w: cf._nd(w, F.lit(0)))
    return F.struct(nd.alias("patterns"), nd.alias("features"))


def _profile_structure(code: Column, profile: LanguageProfile, with_features: bool = True) -> Column:
    if profile.lexer == "html":
        return html_structure(code, profile)
    if profile.lexer == "text":
        return text_structure(code)
    return cf.code_structure(code, profile, with_features)


ND_PAIR = "struct<patterns:array<struct<n:string,d:int>>,features:array<struct<n:string,d:int>>>"


def _structure_expr(code: Column, lang: Column, profiles: Mapping[str, LanguageProfile], langs: list[str],
                    with_features: bool = True, with_lists: bool = True) -> Column:
    """struct<features, normalized, patterns> (string arrays) for one item row; without lists the features are left out."""
    expr = None
    for name in langs:
        p = profiles[name]
        branch = _profile_structure(code, p, with_features)
        expr = F.when(lang == name, branch) if expr is None else expr.when(lang == name, branch)
    expr = expr.otherwise(F.raise_error(F.concat(F.lit("no profile for the language "), lang)).cast(ND_PAIR))
    blank = ~F.regexp_like(F.coalesce(code, F.lit("")), F.lit(BLANK_RE))
    empty = F.struct(F.array().cast(cf.ND_ARRAY).alias("patterns"), F.array().cast(cf.ND_ARRAY).alias("features"))
    raw = F.when(blank, empty).otherwise(expr)

    def finish(s: Column) -> Column:
        norm = None
        for name in langs:
            branch = cf.shifted_strings(s["features"], profiles[name])
            norm = F.when(lang == name, branch) if norm is None else norm.when(lang == name, branch)
        features = [cf.nd_strings(s["features"]).alias("features")] if with_lists else []
        return F.struct(*features, norm.alias("normalized"), cf.shifted_strings(s["patterns"]).alias("patterns"))

    return let(raw, finish)


def _plain_code(code: Column, lang: Column, profiles: Mapping[str, LanguageProfile], langs: list[str], **kw) -> Column | None:
    """What :mod:`codefold` makes of the rows it may take, null for all others; none if no language has a code lexer."""
    held = {n: profiles[n] for n in langs if profiles[n].lexer in codefold.CODE_LEXERS}
    if not held:
        return None
    blank = ~F.regexp_like(F.coalesce(code, F.lit("")), F.lit(BLANK_RE))
    plain = lang.isin(*held) & ~blank & ~F.regexp_like(code, F.lit(codefold.NOT_ASCII))
    return codefold.code_columns(F.when(plain, code), lang, held, **kw)


def structure(items: DataFrame, profiles: Mapping[str, LanguageProfile] = DEFAULT_PROFILES,
              languages: Iterable[str] | None = None, keep: Iterable[str] = (),
              id_col: str = "item_id", lang_col: str = "language", code_col: str = "code",
              with_features: bool = True) -> DataFrame:
    """(item_id, language, features, normalized, patterns) for every item.

    ``features``: ``node:d<depth>`` for structural nodes in preorder.
    ``normalized``: node names mapped to patterns where mapped, depths minus the
    item minimum. ``patterns``: control-flow list. Whitespace-only text has no
    structure. ``with_features=False`` computes the control-flow list only
    (code profiles skip the feature-only tokenizer passes; features are empty). Unknown languages raise at run time (use ``quarantine_unknown``
    first to split them off).
    """
    langs = list(languages) if languages is not None else list(profiles)
    code, lang = F.col(code_col), F.col(lang_col)
    folded = _structure_expr(code, lang, profiles, langs, with_features)
    plain = _plain_code(code, lang, profiles, langs, with_features=with_features, with_lists=True)
    s = items.select(F.col(id_col).alias("item_id"), lang.alias("language"), *keep,
                     (folded if plain is None else F.coalesce(plain, folded)).alias("_s"))
    cols = [c for c in s.columns if c != "_s"]
    return s.select(*cols, "_s.features", "_s.normalized", "_s.patterns")


def _fp_expr(st: Column, cfg: DetectorConfig, with_lists: bool = True, with_sets: bool = True) -> Column:
    def build(s: Column) -> Column:
        def with_sh(sh: Column) -> Column:
            hx = fingerprint_hex(sh, cfg)
            lists = [s["features"].alias("features"), s["normalized"].alias("normalized"),
                     sh.alias("shingles")] if with_lists else []
            sets = [pattern_set(s["patterns"]).alias("pset")] if with_sets else []
            return let(hx, lambda h: F.struct(
                *lists[:2], s["patterns"].alias("patterns"), *lists[2:], h.alias("hash_hex"), *sets,
                *[hash_word(h, j).alias(f"h{j}") for j in range(cfg.hash_words)]))
        return let(adaptive_shingles(s["normalized"], cfg), with_sh)
    return let(st, build)


def fingerprint_items(items: DataFrame, profiles: Mapping[str, LanguageProfile] = DEFAULT_PROFILES,
                      languages: Iterable[str] | None = None, keep: Iterable[str] = (),
                      cfg: DetectorConfig = DetectorConfig(),
                      id_col: str = "item_id", lang_col: str = "language", code_col: str = "code",
                      with_lists: bool = True, with_sets: bool = True) -> DataFrame:
    """Structure + fingerprint of every item in one narrow projection.

    Columns: item_id, language, <keep>, features, normalized, patterns,
    shingles (adaptive k), hash_hex, pset (distinct sorted 2-shingles of
    patterns), h0..h{n} (hash as signed 64-bit words). ``with_lists=False``
    leaves out features, normalized and shingles, which comparisons never read; ``with_sets=False`` leaves out pset.
    """
    langs = list(languages) if languages is not None else list(profiles)
    code, lang = F.col(code_col), F.col(lang_col)
    made = _fp_expr(_structure_expr(code, lang, profiles, langs, with_lists=with_lists), cfg, with_lists, with_sets)
    plain = _plain_code(code, lang, profiles, langs, with_features=True, with_lists=with_lists, hashed=cfg,
                        with_sets=with_sets)
    out = items.select(F.col(id_col).alias("item_id"), lang.alias("language"), *keep,
                       (made if plain is None else F.coalesce(plain, made)).alias("_f"))
    cols = [c for c in out.columns if c != "_f"]
    return out.select(*cols, "_f.*")


def fingerprints(structured: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Adds shingles, hash_hex, pset and hash words to a :func:`structure` frame."""
    st = F.struct("features", "normalized", "patterns")
    rest = [c for c in structured.columns if c not in ("features", "normalized", "patterns")]
    return structured.select(*rest, _fp_expr(st, cfg).alias("_f")).select(*rest, "_f.*")
