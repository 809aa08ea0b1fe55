"""Node streams: the engine's long-form structure IR ``(item_id, pos, node_type, depth)``.

* html: tags of a page after script/style/comment bodies are removed; depth is
  the number of open non-void tags before the tag (a running sum over the tag
  sequence of one page, so the partition is bounded by one page).
* sequence: events of a user in (ts, event_id) order. A user may hold a third
  of all events, so positions are computed in two levels: rows are numbered
  inside (user, time bucket) and bucket offsets come from a running sum over
  one row per bucket. No task ever holds a whole user.
* text: word tokens at depth 0 (computed in-row, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import HTML, HTML_VOID_TAGS, LanguageProfile
from ..functions.text import strip_noise

TAG_RE = r"</?[A-Za-z][A-Za-z0-9]*[^>]*>"
TAG_NAME_RE = r"^</?([A-Za-z][A-Za-z0-9]*)"
WORD_RE = r"[\p{L}\p{N}]+"


def html_tags(items: DataFrame, id_col: str = "item_id", code_col: str = "code") -> DataFrame:
    """One row per tag token: (item_id, pos, tok, node_type, is_close, delta)."""
    toks = F.regexp_extract_all(strip_noise(F.col(code_col), "html"), F.lit(TAG_RE), 0)
    t = items.select(F.col(id_col).alias("item_id"), F.posexplode(toks).alias("pos", "tok"))
    is_close = F.col("tok").startswith("</")
    name = F.lower(F.regexp_extract("tok", TAG_NAME_RE, 1))
    void = name.isin(*HTML_VOID_TAGS) | F.col("tok").endswith("/>")
    return t.select(
        "item_id", F.col("pos").cast("int").alias("pos"), name.alias("node_type"),
        is_close.alias("is_close"),
        F.when(is_close, -1).when(void, 0).otherwise(1).alias("delta"))


def html_node_stream(items: DataFrame, profile: LanguageProfile = HTML,
                     id_col: str = "item_id", code_col: str = "code",
                     with_control_depth: bool = False) -> DataFrame:
    """Open tags with tree depth (and optionally control depth = enclosing mapped tags)."""
    tags = html_tags(items, id_col, code_col)
    before = Window.partitionBy("item_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cols = ["item_id", "pos", "node_type",
            F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("int").alias("depth")]
    if with_control_depth:
        mapped = list(profile.node_to_pattern())
        cdelta = F.when(F.col("node_type").isin(*mapped), F.col("delta")).otherwise(F.lit(0)) if mapped else F.lit(0)
        cols.append(F.coalesce(F.sum(cdelta).over(before), F.lit(0)).cast("int").alias("control_depth"))
    out = tags.select(*cols, "is_close")
    return out.filter(~F.col("is_close")).drop("is_close")


def text_tokens(code_col: str = "code"):
    return F.regexp_extract_all(F.lower(F.col(code_col)), F.lit(WORD_RE), 0)


def text_node_stream(items: DataFrame, id_col: str = "item_id", code_col: str = "code") -> DataFrame:
    t = items.select(F.col(id_col).alias("item_id"), F.posexplode(text_tokens(code_col)).alias("pos", "node_type"))
    return t.select("item_id", F.col("pos").cast("int").alias("pos"), "node_type", F.lit(0).alias("depth"))


def sequence_node_stream(events: DataFrame, item_col: str = "user_id", ts_col: str = "ts",
                         tie_col: str = "event_id", type_col: str = "event_type",
                         bucket_seconds: int = 3600) -> DataFrame:
    """Ordered events of each item as a node stream with a dense 0-based ``pos``.

    Level 1 numbers rows inside (item, bucket); level 2 turns per-bucket counts
    into offsets with a running sum over buckets of one item (one row per
    bucket, bounded by the time span, not by the data volume).
    """
    ev = events.select(F.col(item_col).alias("item_id"), F.col(ts_col).alias("ts"),
                       F.col(tie_col).alias("tie"), F.col(type_col).alias("node_type"))
    ev = ev.withColumn("bucket", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)))
    inner = Window.partitionBy("item_id", "bucket").orderBy("ts", "tie")
    ev = ev.withColumn("rn", F.row_number().over(inner) - 1)
    counts = ev.groupBy("item_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    prior = Window.partitionBy("item_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("item_id", "bucket", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("offset"))
    out = ev.join(offsets, ["item_id", "bucket"])
    return out.select("item_id", (F.col("offset") + F.col("rn")).cast("long").alias("pos"),
                      "node_type", F.lit(0).alias("depth"), "ts")
