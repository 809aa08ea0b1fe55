"""Helpers the training-data operators share: scratch tables in the shared folder, lineage cuts, table access.

Intermediate tables are written under ``spark.checkpoint.dir`` (a folder all executors share), so a lost executor
costs the re-run of its own tasks only, and an iterative operator never replays its whole history.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table

#: Rule of a word in every contract of this package (fixed values): runs of bytes that are no white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Arrow batches end at this size, so Python workers hold little of a partition with long rows; unless the session
#: sets a size of its own.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
_SPARKS_OWN = "67108864b"

#: A step's shuffle files go when its table is written (Spark's own setting); later steps read the table.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once an application (as ``--py-files`` does)."""
    if spark.conf.get(BATCH[0]) == _SPARKS_OWN:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        made = os.path.join(tempfile.mkdtemp(prefix="simlattice-ship-"), "simlattice")
        spark.sparkContext.addPyFile(shutil.make_archive(made, "zip", os.path.dirname(package),
                                                         os.path.basename(package)))
        _SHIPPED.add(app)


class Scratch:
    """A folder of intermediate tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.option("compression", codec).parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame):
    """All columns of ``df`` as one value, so that columns put beside it cannot clash with names of the input."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_bytes(name: str = "text"):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def give_back() -> None:
    """Return freed memory to the system: workers serve one stage after another, and the C library and Arrow keep what
    arrays of earlier slices and stages took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def rows(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[tuple[dict, list[bytes]]]:
    """Slices of the incoming batches holding about ``max_bytes`` of text (one row at least).

    Yields the other columns as Python lists and the texts as bytes; a text is never cut.
    """
    for batch in batches:
        give_back()
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield _slice(batch, start, i, text)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield _slice(batch, start, len(lengths), text)


def _slice(batch: pa.RecordBatch, start: int, end: int, text: str) -> tuple[dict, list[bytes]]:
    part = batch.slice(start, end - start)
    other = {n: part.column(n).to_pylist() for n in part.schema.names if n != text}
    return other, [t or b"" for t in part.column(text).to_pylist()]


def tasks_for(total: float, per_task: float, least: int = 1) -> int:
    """Number of groups so that each holds about ``per_task`` of ``total``."""
    return max(least, int(-(-total // per_task)))
