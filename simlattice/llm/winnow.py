"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's words are hashed, every ``GRAM`` words make a gram, and of each window of ``SPAN`` words the smallest gram hash
is its fingerprint. Equal windows choose equal fingerprints, so a document and an item that share ``SPAN`` words anywhere
share a fingerprint: the join on fingerprints finds every shared span. A hit is extended to the windows that chose this
gram, which are confirmed by a hash of all their words; the words under confirmed windows are hit. An item of fewer words
is one window that is its own fingerprint, met by all document stretches of that length.

Neighbouring windows with one fingerprint travel as one row. The benchmark's fingerprints are broadcast while there are
no more than ``BROADCAST_ROWS`` (24 bytes each); beyond, the same joins shuffle the fingerprints, never texts. A
document's rows meet again by identifier and content, so rows that are alike in both are counted, not repeated.

Defined results: a null or empty text has no words; a document without hits has the hash of the empty string; items with
a null identifier are one item with an empty one, items of one identifier are one item, items without words occur nowhere;
an empty benchmark leaves all documents clean. Repeated rows and null doc_ids are kept. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.util import let
from .common import Scratch

#: Words of a window: the shortest shared span that is surely found.
SPAN = 10
#: Words of a gram; a window holds SPAN - GRAM + 1 of them.
GRAM = 5
#: Rows of the benchmark's tables that are broadcast (about 50 MB); beyond, the joins shuffle.
BROADCAST_ROWS = 2_000_000
#: Copies of one row that are listed at once.
_LISTED = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule of a word (fixed value): digits, letters a-z and everything beyond ASCII.
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def _words(text: Column) -> Column:
    """Hashes of the words, A-Z lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.regexp_extract_all(lower, F.lit(_WORD), F.lit(1)), lambda w: F.xxhash64(w))


def _places(count: Column) -> Column:
    """0 to ``count`` - 1, empty where there are none."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive words; the size is hashed along."""
    return let(words, lambda w: F.transform(
        _places(F.size(w) - (size - 1)),
        lambda i: F.xxhash64(F.lit(size), *[F.get(w, i + j) for j in range(size)])))


def _spans(words: Column) -> Column:
    """Every run of windows with one fingerprint: ``gram``, first word ``at`` and the ``windows``' hashes in order."""
    width = SPAN - GRAM

    def runs(g: Column) -> Column:
        least = F.transform(_places(F.size(g) - width), lambda i: F.least(*[F.get(g, i + j) for j in range(width + 1)]))

        def cut(m: Column) -> Column:
            firsts = F.filter(_places(F.size(m)), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))

            def rows(f: Column) -> Column:
                return F.transform(f, lambda i, nth: F.struct(
                    F.get(m, i).alias("gram"), i.alias("at"), F.lit(SPAN).alias("span"),
                    F.transform(F.sequence(i, F.coalesce(F.get(f, nth + 1), F.size(m)) - 1),
                                lambda s: F.xxhash64(F.get(g, s), F.get(g, s + GRAM))).alias("windows")))
            return let(firsts, rows)
        return let(least, cut)
    return let(_grams(words, GRAM), runs)


def _short(words: Column, size: int) -> Column:
    """Every stretch of ``size`` words as a window that is its own fingerprint."""
    return F.transform(_grams(words, size), lambda h, i: F.struct(
        h.alias("gram"), i.alias("at"), F.lit(size).alias("span"), F.array(h).alias("windows")))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, win, span, item`` of every window of every item."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                             _words(F.col(text_col)).alias("words"))
    n = F.size("words")
    spans = F.when(n >= SPAN, _spans(F.col("words")))
    for size in range(1, SPAN):
        spans = spans.when(n == size, _short(F.col("words"), size))
    return (items.select("item", F.explode(spans).alias("s"))
            .select("s.gram", F.explode("s.windows").alias("win"), "s.span", "item").distinct())


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "winnow")
    windows = scratch.keep(benchmark_windows(benchmark), "windows")
    small = windows.count() <= broadcast_rows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    # at most SPAN - 1 lengths
    shorts = [r.span for r in windows.filter(F.col("span") < SPAN).select("span").distinct().collect()]
    spans = F.concat(_spans(F.col("words")), *[_short(F.col("words"), size) for size in sorted(shorts)])
    docs = documents.select(F.col(id_col).alias("doc_id"),
                            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("content"),
                            _words(F.col(text_col)).alias("words"))
    # a row for the document itself travels along; its keys are spread
    own = F.xxhash64("content", "doc_id")
    itself = F.array(F.struct(own.alias("gram"), F.lit(-1).alias("at"), F.lit(0).alias("span"), F.array(own).alias("windows")))
    prints = docs.select("doc_id", "content", F.size("words").alias("n"),
                         F.explode(F.concat(itself, spans)).alias("s")).select("doc_id", "content", "n", "s.*")
    grams = windows.select("gram", F.lit(True).alias("met")).distinct()
    hits = (prints.join(side(grams), "gram", "left").filter("met OR at < 0")
            .select("doc_id", "content", "n", "at", "span", F.posexplode("windows").alias("nth", "win")))
    known = windows.select("win", F.col("span").alias("of"), F.lit(True).alias("found")).distinct()
    hits = (hits.join(side(known), (hits["win"] == known["win"]) & (F.col("span") == F.col("of")), "left")
            .filter("found OR at < 0")
            .select("doc_id", "content", "n", "at", "nth", "span", hits["win"].alias("win")))
    hit = F.col("at") >= 0
    per_doc = hits.groupBy("doc_id", "content").agg(
        F.max("n").cast("long").alias("n_words"), F.count(F.when(~hit, 1)).alias("copies"),
        F.collect_set(F.when(hit, F.struct((F.col("at") + F.col("nth")).alias("start"), "span"))).alias("found"),
        F.collect_set(F.when(hit, F.col("win"))).alias("wins"))
    empty = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end"))
    covered = F.aggregate(F.array_sort("found"), empty, lambda a, w: let(
        w["start"] + w["span"], lambda e: F.struct(
            (a["hit"] + F.greatest(F.lit(0), e - F.greatest(w["start"], a["end"]))).alias("hit"),
            F.greatest(a["end"], e).alias("end"))), lambda a: a["hit"])
    per_doc = scratch.keep(per_doc.select(
        "doc_id", "n_words", "copies", covered.alias("n_hit"), F.array_sort("wins").alias("wins"))
        .withColumn("sig", F.when(F.size("wins") > 0, F.sha2(F.array_join(F.col("wins").cast("array<string>"), ","), 256))),
        "documents")
    # documents with the same windows have the same items
    sets = (per_doc.filter("sig IS NOT NULL").groupBy("sig").agg(F.any_value("wins").alias("wins"))
            .select("sig", F.explode("wins").alias("win")))
    items = (sets.join(side(windows.select("win", "item").distinct()), "win").groupBy("sig")
             .agg(F.array_sort(F.collect_set("item")).alias("items"))
             .select(F.col("sig").alias("met"), F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")))
    # a clean document's key is spread, null keys would meet in one task
    key = F.coalesce("sig", F.concat(F.lit("-"), F.xxhash64("doc_id", "n_words").cast("string")))
    judged = per_doc.drop("wins").withColumn("sig", key).join(items, F.col("sig") == F.col("met"), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "copies")
    chunks = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_LISTED}"))
    listed = F.least(F.lit(_LISTED).cast("long"), F.col("copies") - F.col("chunk") * _LISTED).cast("int")
    return (judged.withColumn("chunk", F.explode(chunks)).withColumn("copy", F.explode(F.array_repeat(F.lit(0), listed)))
            .drop("chunk", "copy", "copies"))
