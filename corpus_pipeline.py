"""A training corpus from ``documents``: good, unique texts, mixed to target weights, as SentencePiece ids.

Each stage works on all rows the one before it kept and returns the columns of ``documents``; the last returns ids.
``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from simlattice.llm import exact_dedup, mixing, nbest, ngram_join, quality  # noqa: E402
from simlattice.llm.common import Scratch, documents, ship  # noqa: E402
from simlattice.llm.queries import PIECES  # noqa: E402
from simlattice.session import read_table  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on ``labels``, rejects go."""
    ship(spark)
    return quality.keep_good(docs, quality.grades(read_table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document with the smallest doc_id stays."""
    ship(spark)
    return ngram_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, 0 to 3 times."""
    ship(spark)
    return mixing.take_mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation, the further ones as changes, and the decoded text's crc32."""
    ship(spark)
    return nbest.encode_n_best(docs, PIECES, count=4)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can express neither the trained classifier nor the mix and the segmentations; tests/llm checks each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
