"""Items from the driver tables.

Scans go through ``spread`` (a plain file scan: the partition check runs no job)
so the per-item folds use every core even when a table is one small file.

Each builder only reshapes columns into the item schema
``(item_id long, language string, code string, ...)``; all structure work is
done by the operators on whatever text arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, spread


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> html items keyed by page_id; file_path is the url path."""
    p = spread(read_table(spark, sf_dir, "pages"))
    return p.select(F.col("page_id").alias("item_id"), F.lit("html").alias("language"),
                    F.col("html").alias("code"), F.col("url"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> text items; ``lang`` stays the bank language column."""
    d = spread(read_table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("item_id"), F.lit("text").alias("language"),
                    F.col("text").alias("code"), "lang", "source", "n_chars")


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spread(read_table(spark, sf_dir, "benchmark"))
    return b.select(F.col("item_id"), F.lit("text").alias("language"), F.col("text").alias("code"))


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(read_table(spark, sf_dir, "conversations"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "conv_id", "turn",
                    F.lit("text").alias("language"), F.col("text").alias("code"))
