"""Queries over ``pages`` (html profile): node stream, features, fingerprints,
pairs, groups, searches. Each function takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_PROFILES, HTML, MATRIX_MAX_FILES, MATRIX_NAME_CHARS, update_patterns
from ..functions import similarity as sim
from ..functions.shingles import adaptive_k, shingles
from ..operators import pairs as P
from ..operators import search as S
from ..operators.nodes import html_node_stream
from ..operators.structure import fingerprint_items, structure
from ..sources.tables import page_items

ALL_PAIRS_T = 0.9
HAMMING_T = 0.9
JACCARD_T = 0.9
SEARCH_SYN_T = 0.9
SEARCH_STRUCT_T = 0.5
#: The operators' own defaults, which the queries named ``_default`` use.
DEFAULT_PAIRS_T = 0.6
DEFAULT_SYN_T = 0.97
SEARCH_LIMIT = 100
SHOWN = 10
CUSTOM_HTML_PATTERNS = {"BLOCK": ["div", "article", "section"], "COND": ["p"]}


def _struct(spark: SparkSession, sf: str, profiles=DEFAULT_PROFILES) -> DataFrame:
    return structure(page_items(spark, sf), profiles, languages=["html"])


def _fp(spark: SparkSession, sf: str, with_lists: bool = True) -> DataFrame:
    """Fingerprints of every page (url host as source, url as file_path), computed once."""
    items = page_items(spark, sf).withColumn(
        "source", F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1)).withColumnRenamed("url", "file_path")
    return fingerprint_items(items, languages=["html"], keep=["source", "file_path"], with_lists=with_lists).persist()


def page_bank(fp: DataFrame) -> DataFrame:
    """pages as a searchable bank: id, source (url host), file_path (url), language."""
    return fp.withColumnRenamed("item_id", "id")


def page_queries(fp: DataFrame) -> DataFrame:
    return fp.withColumnRenamed("item_id", "query_id")


def node_stream_html(spark, sf):
    return html_node_stream(page_items(spark, sf))


def features_html(spark, sf):
    return _struct(spark, sf).select("item_id", "features")


def normalize_features(spark, sf):
    return _struct(spark, sf).select("item_id", "normalized")


def debug_patterns(spark, sf):
    return _struct(spark, sf).select("item_id", "features", "normalized", F.col("patterns").alias("control_flow"))


def shingles_k2(spark, sf):
    """2-shingles of each page's control-flow list (hasher convention: 'empty')."""
    return _struct(spark, sf).select("item_id", shingles("patterns", 2, empty_token=True).alias("shingles"))


def shingles_adaptive(spark, sf):
    s = _struct(spark, sf)
    k = adaptive_k("normalized")
    return s.select("item_id", k.alias("k"), shingles("normalized", k).alias("shingles"))


def fingerprint(spark, sf):
    return _fp(spark, sf).select("item_id", "hash_hex", "patterns", "shingles")


def fingerprint_groups(spark, sf):
    return P.fingerprint_groups(_fp(spark, sf))


def hamming_pairs(spark, sf):
    return P.hamming_pairs(_fp(spark, sf), HAMMING_T)


def jaccard_pairs(spark, sf):
    return P.jaccard_pairs(_fp(spark, sf), JACCARD_T)


def all_pairs(spark, sf):
    return P.all_pairs(_fp(spark, sf), ALL_PAIRS_T, syn_t=ALL_PAIRS_T)


def all_pairs_default(spark, sf):
    """All pairs at the default thresholds, where every confidence occurs."""
    return P.all_pairs(_fp(spark, sf), DEFAULT_PAIRS_T, syn_t=DEFAULT_SYN_T)


def item_matrix(spark, sf):
    """Item x item similarity of the first pages of the largest groups of equal fingerprints (a report of fixed size)."""
    fp = _fp(spark, sf)
    groups = fp.groupBy("hash_hex").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))
    chosen = groups.orderBy(F.desc("n"), "item_id").limit(MATRIX_MAX_FILES).select("item_id")
    name = F.substring("file_path", 1, MATRIX_NAME_CHARS)
    return P.item_matrix(fp.withColumn("name", name), chosen)


def pair_count(spark, sf):
    """Suspicious pairs above the threshold (sum of grouped pair counts)."""
    return P.all_pairs(_fp(spark, sf), ALL_PAIRS_T, syn_t=ALL_PAIRS_T).agg(F.sum("n_pairs").cast("bigint").alias("n_pairs"))


def pair_budget(spark, sf):
    return P.pair_budget(page_items(spark, sf))


def custom_patterns(spark, sf):
    profiles = update_patterns(DEFAULT_PROFILES, "html", CUSTOM_HTML_PATTERNS)
    s = _struct(spark, sf, profiles)
    return s.select("item_id", "normalized", "patterns")


def _with_source(bank: DataFrame):
    return lambda hits, _: S.attach_bank(hits, bank, ("source", "file_path", "language"))


def search_syntactic(spark, sf):
    fp = _fp(spark, sf)
    bank = page_bank(fp)
    hits = S.search_syntactic(page_queries(fp), bank, SEARCH_SYN_T, SEARCH_LIMIT)
    return S.attach_bank(hits, bank, ("source", "file_path", "language"))


def search_structural(spark, sf):
    fp = _fp(spark, sf)
    bank = page_bank(fp)
    hits = S.search_structural(page_queries(fp), bank, SEARCH_STRUCT_T, SEARCH_LIMIT)
    return S.attach_bank(hits, bank, ("source", "file_path", "language"))


def search_combined(spark, sf):
    fp = _fp(spark, sf, with_lists=False)
    bank = page_bank(fp)
    return S.search_combined(page_queries(fp), bank, SEARCH_SYN_T, SEARCH_LIMIT, syn_t=SEARCH_SYN_T, then=_with_source(bank))


def search_combined_default(spark, sf):
    """The combined search at the default thresholds of its two methods."""
    fp = _fp(spark, sf, with_lists=False)
    bank = page_bank(fp)
    return S.search_combined(page_queries(fp), bank, SEARCH_STRUCT_T, SEARCH_LIMIT, syn_t=DEFAULT_SYN_T,
                             then=_with_source(bank))


def search_combined_true(spark, sf):
    fp = _fp(spark, sf, with_lists=False)
    bank, queries = page_bank(fp), page_queries(fp)
    return S.search_combined(queries, bank, SEARCH_SYN_T, SEARCH_LIMIT, syn_t=SEARCH_SYN_T,
                             then=lambda hits, asked: S.with_true_scores(hits, asked, bank))


def top_k_per_query(spark, sf):
    """The hits a user is shown: first 10 of the combined search, with rank and badge."""
    fp = _fp(spark, sf)
    bank, queries = page_bank(fp), page_queries(fp)
    hits = S.search_combined(queries, bank, SEARCH_SYN_T, SEARCH_LIMIT, syn_t=SEARCH_SYN_T)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id"))
    ranked = hits.select("query_id", "id", "similarity", "match_type", F.row_number().over(w).cast("long").alias("rank"))
    return ranked.filter(F.col("rank") <= SHOWN).withColumn("badge", sim.badge("similarity"))


def badge(spark, sf):
    fp = _fp(spark, sf)
    bank, queries = page_bank(fp), page_queries(fp)
    hits = S.search_structural(queries, bank, SEARCH_STRUCT_T, SEARCH_LIMIT)
    return hits.select("query_id", "id", "similarity", sim.badge("similarity").alias("badge"))


QUERIES = {f.__name__: f for f in (
    node_stream_html, features_html, normalize_features, debug_patterns, shingles_k2, shingles_adaptive,
    fingerprint, fingerprint_groups, hamming_pairs, jaccard_pairs, all_pairs, pair_count, pair_budget,
    custom_patterns, all_pairs_default, item_matrix, search_combined_default, search_syntactic, search_structural, search_combined, search_combined_true,
    top_k_per_query, badge)}
