"""The operators over their whole tables, with production parameters: one query each."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import ann, collocations, conversation, exact_dedup, langid, mixing, nbest, ngram_join, pst, quality, token_store, url_filter, winnow
from .common import documents, ship



def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; ``SIMLATTICE_TOKENIZERS`` names another folder."""
    folder = os.environ.get("SIMLATTICE_TOKENIZERS")
    return os.path.join(folder, name) if folder else str(public_tokenizers.path(name))


BYTE_BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document, learned from ``labels``."""
    ship(spark)
    return quality.score_quality(documents(spark, sf_dir), quality.grades(read_table(spark, sf_dir, "labels")))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors of every twentieth vector."""
    ship(spark)
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; the largest doc_id stays."""
    ship(spark)
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="max")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets have Jaccard similarity 0.75 or more."""
    ship(spark)
    return ngram_join.ngram_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op4_ngram_join, with each document's class of equal sets and its number of links."""
    ship(spark)
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules on every page's url."""
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    ship(spark)
    return langid.identify(documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as binary shards and read back."""
    ship(spark)
    return token_store.token_store(documents(spark, sf_dir), BYTE_BPE, end_id=2)


def op8_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document, and the decoded text's crc32."""
    ship(spark)
    return nbest.encode_n_best(documents(spark, sf_dir), PIECES, count=4)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix of all sources."""
    ship(spark)
    return mixing.mix_sources(documents(spark, sf_dir)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken", "source", "rate", "copies")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document's text."""
    ship(spark)
    return pst.score_texts(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest phrases."""
    ship(spark)
    return collocations.collocations(documents(spark, sf_dir))


def op12_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document under windows of benchmark items, and the items."""
    return winnow.decontaminate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its hash of every conversation, after the rule's damage."""
    ship(spark)
    return conversation.repair_damaged(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents table."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality, "op2_nearest": op2_nearest, "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_join": op4_ngram_join, "op4_ngram_links": op4_ngram_links,
    "op5_url_filter": op5_url_filter, "op6_language": op6_language,
    "op7_token_store": op7_token_store, "op8_nbest": op8_nbest, "op9_mix": op9_mix,
    "op10_suffix_tree": op10_suffix_tree, "op11_collocations": op11_collocations, "op12_winnow": op12_winnow, "op13_conversation": op13_conversation, "pipeline": pipeline,
}
