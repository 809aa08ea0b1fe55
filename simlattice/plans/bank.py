"""Queries over the reference bank built from ``documents`` (text profile).

Bank layout: id = doc_id, source = documents.source, language = documents.lang,
file_path = '<lang>/doc_<id>.txt', fingerprint from the word profile.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PREVIEW_ADD, PREVIEW_BROWSE, PREVIEW_SEARCH
from ..operators import bank as B
from ..operators import pairs as P
from ..operators.structure import BLANK_RE, fingerprint_items
from ..session import ensure_checkpoint_dir, kept_table, read_table
from ..sources.tables import document_items

BROWSE_LANGUAGE, BROWSE_TERM = "en", "doc_1"
FILTER_SOURCE, FILTER_LANGUAGE = "src3", "en"
NEAR_COPY_T = 0.9
PASSAGE_T = 0.1


def doc_fp(spark: SparkSession, sf: str) -> DataFrame:
    items = document_items(spark, sf)
    return fingerprint_items(items, languages=["text"],
                             keep=["lang", "source", F.length("code").cast("bigint").alias("size")])


def doc_bank(spark: SparkSession, sf: str, with_code: bool = False) -> DataFrame:
    fp = doc_fp(spark, sf)
    file_path = F.concat(F.col("lang"), F.lit("/doc_"), F.col("item_id").cast("string"), F.lit(".txt"))
    out = fp.select(F.col("item_id").alias("id"), "source", file_path.alias("file_path"),
                    F.col("lang").alias("language"), "size", "hash_hex", "patterns", "pset",
                    *[f"h{j}" for j in range(4)],
                    F.create_map().cast("map<string,string>").alias("metadata"),
                    F.current_timestamp().alias("created_at"))
    if with_code:
        docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))
        out = out.join(docs, "id")
    return out


BASIC = ["id", "source", "file_path", "language", "size"]


def bank_scan(spark, sf):
    b = doc_bank(spark, sf)
    return b.select(*BASIC, "hash_hex", F.size("patterns").cast("bigint").alias("n_patterns"))


def bank_reload(spark, sf):
    """Write the bank (forced reload) into the shared checkpoint folder and report rows loaded."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "bank-" + uuid.uuid4().hex)
    n = B.write_bank(doc_bank(spark, sf).drop("pset", "h0", "h1", "h2", "h3"), path, "overwrite")
    n2 = B.write_bank(doc_bank(spark, sf).drop("pset", "h0", "h1", "h2", "h3"), path, "ignore")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_loaded")).select(
        "n_loaded", F.lit(n).cast("bigint").alias("n_written"), F.lit(n2).cast("bigint").alias("n_kept"))


def detect_language(spark, sf):
    p = read_table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    from ..functions.text import extension
    return p.select("page_id", extension(path).alias("ext"),
                    B.detect_language(path, "lenient").alias("lang_detect"),
                    B.detect_language(path, "upload").alias("lang_upload"),
                    B.detect_language(path, "bank").alias("lang_bank"))


def provenance(spark, sf):
    p = read_table(spark, sf, "pages")
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    rel = F.regexp_replace(path, r"^/+", "")
    return p.select("page_id", F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]+)", 1).alias("source"),
                    rel.alias("file_path"), *B.provenance(path, F.col("html")))


def filter_bank(spark, sf):
    return B.filter_bank(doc_bank(spark, sf), FILTER_SOURCE, FILTER_LANGUAGE).select(*BASIC)


def browse_bank(spark, sf):
    return B.browse(doc_bank(spark, sf), BROWSE_LANGUAGE, None, BROWSE_TERM).select(*BASIC)


def blank_items(spark, sf):
    d = read_table(spark, sf, "documents")
    blank = ~F.regexp_like(F.coalesce("text", F.lit("")), F.lit(BLANK_RE))
    fp = doc_fp(spark, sf)
    return d.select(F.col("doc_id").alias("item_id"), blank.alias("is_blank")).join(
        fp.select("item_id", F.size("patterns").cast("bigint").alias("n_nodes")), "item_id")


def preview(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))
    return B.previews(d, {"preview_browse": PREVIEW_BROWSE, "preview_search": PREVIEW_SEARCH,
                          "preview_add": PREVIEW_ADD})


def get_item(spark, sf):
    labels = read_table(spark, sf, "labels")
    b = B.get_items(doc_bank(spark, sf), labels, "doc_id")
    return b.join(labels.withColumnRenamed("doc_id", "id"), "id").select(*BASIC, "hash_hex", "quality", "toxic")


def codec_roundtrip(spark, sf):
    """Encode each record to its storage text and decode it back (one projection, no join)."""
    b = doc_bank(spark, sf)
    enc = B.encode(b.select("id", "hash_hex", "patterns", "metadata",
                            F.struct("hash_hex", "patterns", "metadata").alias("_orig")), keep=["_orig"])
    dec = B.decode(enc, keep=["_orig", "hash_value", "patterns_text", "metadata_json"])
    same = ((F.col("hash_hex") == F.col("_orig.hash_hex")) & (F.col("patterns") == F.col("_orig.patterns"))
            & (F.size("metadata") == F.size("_orig.metadata")))
    return dec.select("id", "hash_value", F.length("patterns_text").cast("bigint").alias("patterns_chars"),
                      "metadata_json", same.alias("roundtrip_ok"))


def _conversation_rows(spark, sf) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    items = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.lit("text").alias("language"),
                     F.col("text").alias("code"), "conv_id", "turn")
    fp = fingerprint_items(items, languages=["text"],
                           keep=["conv_id", "turn", F.length("code").cast("bigint").alias("size")])
    return fp.select(F.col("item_id").alias("id"), F.lit("conversations").alias("source"),
                     F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file_path"),
                     F.lit("text").alias("language"), "size", "hash_hex", "patterns",
                     F.create_map().cast("map<string,string>").alias("metadata"),
                     F.current_timestamp().alias("created_at"), F.col("turn").cast("long").alias("_seq"))


def bank_upsert(spark, sf):
    """Every conversation turn is an insert-or-replace of file conv_<id>.txt, in turn order."""
    bank = doc_bank(spark, sf).drop("pset", "h0", "h1", "h2", "h3")
    out = B.upsert(bank, _conversation_rows(spark, sf))
    return out.select(*BASIC, "hash_hex")


def bank_append(spark, sf):
    """Uploads: benchmark items added with a user-chosen source and ``added_via`` metadata."""
    bank = doc_bank(spark, sf).drop("pset", "h0", "h1", "h2", "h3")
    bm = read_table(spark, sf, "benchmark")
    name = F.concat(F.lit("item_"), F.col("item_id").cast("string"), F.lit(".txt"))
    items = bm.select(F.col("item_id"), name.alias("file_path"), B.detect_language(name, "upload").alias("language"),
                      F.col("text").alias("code"))
    fp = fingerprint_items(items, keep=["file_path", F.length("code").cast("bigint").alias("size")])
    max_id = bank.agg(F.max("id")).scalar()   # scalar subquery: one value, no join
    new = fp.select((max_id + F.col("item_id") + 1).alias("id"), F.lit("benchmark").alias("source"),
                    "file_path", "language", "size", "hash_hex", "patterns",
                    F.create_map(F.lit("added_via"), F.lit("upload")).alias("metadata"),
                    F.current_timestamp().alias("created_at"), F.col("item_id").cast("long").alias("_seq"))
    out = B.upsert(bank, new)
    return out.filter(F.col("source") == "benchmark").select(
        *BASIC, "hash_hex", F.col("metadata")["added_via"].alias("added_via"))


def bank_stats(spark, sf):
    return B.stats(doc_bank(spark, sf))


def bank_cardinality(spark, sf):
    return B.cardinality(doc_bank(spark, sf))


def all_pairs_documents(spark, sf):
    """Near copies among documents: grouped pairs with similarity >= 0.9."""
    return P.all_pairs(doc_fp(spark, sf), NEAR_COPY_T, syn_t=NEAR_COPY_T)


def search_benchmark(spark, sf):
    """Where were benchmark passages copied from: passages (query side) against the documents bank."""
    from ..operators import search as S
    from ..sources.tables import benchmark_items
    # the search reads the bank several times; of the patterns it asks only whether there are any
    bank = kept_table(doc_bank(spark, sf).select("id", "source", "file_path", "language", "pset",
                                                 F.slice("patterns", 1, 1).alias("patterns")), "bank")
    queries = fingerprint_items(benchmark_items(spark, sf), languages=["text"]).withColumnRenamed("item_id", "query_id")
    hits = S.search_structural(queries, bank, PASSAGE_T, 100)
    return S.attach_bank(hits, bank, ("source", "file_path", "language"))


QUERIES = {f.__name__: f for f in (search_benchmark, 
    bank_scan, bank_reload, detect_language, provenance, filter_bank, browse_bank, blank_items, preview,
    get_item, codec_roundtrip, bank_upsert, bank_append, bank_stats, bank_cardinality, all_pairs_documents)}
