"""Ordered sequences: user event streams as node streams and k-shingles.

A user may hold a third of all events, so nothing here partitions by user
alone: positions come from two-level numbering (see ``sequence_node_stream``)
and k-windows are formed inside chunks of positions (user, pos // CHUNK), which
spread a hot user over every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.nodes import sequence_node_stream
from ..session import read_table

K = 3
#: Positions of a chunk whose windows one task forms.
CHUNK = 4096


def node_stream_seq(spark, sf):
    return sequence_node_stream(read_table(spark, sf, "events")).select("item_id", "pos", "node_type", "depth")


def sequence_shingles(stream: DataFrame, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """(item_id, pos, shingle): k consecutive node types joined by a space.

    Positions are cut into chunks of ``chunk``; the first k - 1 nodes of a chunk also stand at the end of the chunk before
    (its halo), so every window lies in one chunk and one exchange by (item, chunk) serves all of them. Items with fewer
    than k nodes give one shingle of all their nodes at pos 0.
    """
    at = F.floor(F.col("pos") / chunk).cast("long")
    inside = (F.col("pos") >= chunk) & (F.col("pos") % chunk < k - 1)
    nodes = stream.select("item_id", "pos", "node_type", F.explode(
        F.when(inside, F.array(at, at - 1)).otherwise(F.array(at))).alias("chunk"))
    w = Window.partitionBy("item_id", "chunk").orderBy("pos")
    ahead = [F.lead("node_type", j).over(w) for j in range(1, k)]
    rows = nodes.select("item_id", "pos", "chunk", F.array("node_type", *ahead).alias("t"))
    own = rows.filter(F.floor(F.col("pos") / chunk) == F.col("chunk"))
    # a window with a gap ends its item; only one that starts at 0 is an item's single shingle
    whole = F.col("t")[k - 1].isNotNull()
    return own.filter(whole | (F.col("pos") == 0)).select(
        "item_id", "pos", F.array_join("t", " ").alias("shingle"))


def shingles_k3(spark, sf):
    return sequence_shingles(sequence_node_stream(read_table(spark, sf, "events")), K)


QUERIES = {"node_stream_seq": node_stream_seq, "shingles_k3": shingles_k3}
