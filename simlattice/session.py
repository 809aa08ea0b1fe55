"""Spark session helpers.

The engine never hand-schedules work: it sets the knobs a cluster operator would
(AQE, skew join, UTC session time) and leaves physical planning to Catalyst.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "simlattice",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session configured for the engine (UI off, AQE on, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) a private scratch folder is chosen.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="simlattice-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: A query's shuffle files go when it has ended (Spark's own setting).
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that end in this block, such as writes of tables that later steps read, leave no shuffle files."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back (survives executor loss, unlike a cache)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to ``simlattice.spread`` partitions, where the session sets it.

    Off unless set: a cluster's inputs have many splits, and a shuffle of raw text in front of a map-only stage is
    waste. A local run over a file with a single row group sets it to its number of cores.
    """
    n = int(df.sparkSession.conf.get("simlattice.spread", "0"))
    return df.repartition(n) if n > 0 else df


def shuffle_width(spark: SparkSession) -> int:
    """Task count for CPU-heavy stages after a shuffle: the configured shuffle
    partitions, at least the cluster's cores (AQE would otherwise coalesce a
    small-but-expensive stage into a few tasks)."""
    conf = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, spark.sparkContext.defaultParallelism)
