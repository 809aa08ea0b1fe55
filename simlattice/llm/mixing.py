"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate (expected number of copies). Of all rates that meet the token target of every
source, it takes those closest in relative entropy to "one copy each", within the limit on repeats. Their form is known
from the dual: ``rate = min(limit, exp(tilt_of_source * size / mean_size_of_source))``, and the dual is convex with one
tilt a source. Newton steps on all tilts at once are grouped sums over a table of (source, size, documents), the
sufficient statistic; a bracket a source guards each step. Rates become whole copies: the integer part, and one more
for documents whose hash falls below a threshold, set for each source by refining a histogram so that its words come
just below its target; a few single documents, each the largest that still fits, fill the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Scratch

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3
BINS = 4096
LEVELS = 3
FILL = 4
TOLERANCE = 1e-9
MAX_STEPS = 200

_SOURCES = T.StructType([
    T.StructField("__source", T.StringType()), T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("tilt", T.DoubleType()), T.StructField("full", T.BooleanType()),
    T.StructField("low", T.DoubleType()), T.StructField("width", T.DoubleType()),
    T.StructField("need", T.DoubleType()), T.StructField("extra", T.ArrayType(T.DoubleType()))])


def word_count(text: str = "text") -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: int = LIMIT) -> list[float]:
    """Share of the total by weight; a target stops at ``limit`` times its size and its excess is shared again."""
    out, rest, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        over = {i for i in open_ if rest * weights[i] / weight > limit * sizes[i]}
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in sorted(over):
            out[i] = float(limit * sizes[i])
        rest -= sum(out[i] for i in sorted(over))
        open_ -= over
    return out


def _rate(limit: int) -> Column:
    tilted = F.least(F.lit(float(limit)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))
    return F.when(F.col("full"), F.lit(float(limit))).otherwise(tilted)


def _uniform(id_col: str) -> Column:
    """A number in [0, 1) that depends on the identifier alone."""
    return F.pmod(F.xxhash64(F.lit(20240229), F.col(id_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _with_sources(df: DataFrame, state: list[dict]) -> DataFrame:
    found = df.sparkSession.createDataFrame([tuple(s[f.name] for f in _SOURCES) for s in state], _SOURCES)
    return df.join(found, df["__src"].eqNullSafe(found["__source"]))


def _newton(counts: DataFrame, state: list[dict], limit: int) -> None:
    """Solve the dual for all sources; each step is one grouped sum over (source, size) counts."""
    bracket = [[-math.inf, math.inf] for _ in state]
    for s in state:
        s["full"] = s["target"] >= limit * s["source_size"] * (1 - 1e-12)
        s["tilt"] = 0.0 if s["full"] or not s["source_size"] else math.log(max(s["target"] / s["source_size"], 1e-300))
    key = {s["__source"]: i for i, s in enumerate(state)}
    for _ in range(MAX_STEPS):
        rate = _rate(limit)
        words = F.col("docs") * F.col("size")
        sums = {key[r["__source"]]: (r["taken"], r["slope"]) for r in _with_sources(counts, state).groupBy("__source").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < limit, words * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope")
        ).collect()}
        moved = False
        for i, s in enumerate(state):
            taken, slope = sums.get(i, (0.0, 0.0))
            gap = s["target"] - (taken or 0.0)
            if s["full"] or not s["source_size"] or abs(gap) <= TOLERANCE * s["target"]:
                continue
            low, high = bracket[i]
            low, high = (s["tilt"], high) if gap > 0 else (low, s["tilt"])
            bracket[i] = [low, high]
            step = s["tilt"] + gap / slope if slope else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else s["tilt"] + math.copysign(
                    1 + abs(s["tilt"]), gap)
            if step != s["tilt"]:
                s["tilt"], moved = step, True
        if not moved:
            return


def _thresholds(docs: DataFrame, state: list[dict], limit: int) -> None:
    """Set ``low``: documents with hash - fraction below it get one more copy.

    Each level sums the words of the candidates in ``BINS`` bins of the interval in which the target is met and keeps
    the bin that crosses it; the last such bin is left.
    """
    key = {s["__source"]: s for s in state}
    for s in state:
        s["low"], s["width"], s["need"] = -1.0, 2.0, 0.0
    rate = _rate(limit)
    whole = _with_sources(docs, state).groupBy("__source").agg(F.sum(F.floor(rate) * F.col("size")).alias("whole"))
    for r in whole.collect():
        key[r["__source"]]["need"] = key[r["__source"]]["target"] - float(r["whole"] or 0)
    for level in range(LEVELS):
        at = F.col("u") - (rate - F.floor(rate))
        place = F.floor((at - F.col("low")) / F.col("width") * BINS)
        found = _with_sources(docs, state).withColumn("bin", place).filter(
            (F.floor(rate) < limit) & F.col("bin").between(0, BINS - 1)).groupBy("__source", "need", "bin").agg(
            F.sum("size").cast("double").alias("words"))
        upto = Window.partitionBy("__source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("upto", F.sum("words").over(upto))
        rows = found.filter("upto >= need").groupBy("__source").agg(F.min(F.struct("bin", "words", "upto")).alias("x"))
        crossed = {r["__source"]: r["x"] for r in rows.collect()}
        for s in state:
            x = crossed.get(s["__source"])
            if s["need"] <= 0:
                s["width"] = 0.0 if level == LEVELS - 1 else s["width"]
                continue
            if x is None:  # even all candidates do not reach the target
                s["low"], s["need"] = s["low"] + s["width"], 0.0
                continue
            before = x["upto"] - x["words"]
            step = s["width"] / BINS
            s["low"] += step * x["bin"]
            s["need"] -= before
            s["width"] = step


def _fill(docs: DataFrame, state: list[dict], limit: int) -> None:
    """Give one more copy to the largest document that fits what is missing, a few times a source."""
    key = {s["__source"]: s for s in state}
    for _ in range(FILL):
        now = _with_sources(docs, state).withColumn("copies", _copies(limit))
        short = now.groupBy("__source").agg(F.sum(F.col("copies") * F.col("size")).cast("double").alias("taken"))
        for r in short.collect():
            key[r["__source"]]["need"] = key[r["__source"]]["target"] - r["taken"]
        open_ = _with_sources(docs, state).withColumn("copies", _copies(limit)).filter(
            (F.col("copies") < limit) & (F.col("size") > 0) & ~F.array_contains("extra", F.col("u")))
        # rows that share a hash move together, so they count together
        same = open_.groupBy("__source", "need", "u").agg(F.sum("size").alias("words")).filter("words <= need")
        picked = same.groupBy("__source").agg(F.max(F.struct("words", "u")).alias("x")).collect()
        for r in picked:
            key[r["__source"]]["extra"].append(r["x"]["u"])
        if not picked:
            return


def solve(docs: DataFrame, scratch: Scratch, id_col: str, source_col: str, weights=WEIGHTS,
          limit: int = LIMIT) -> list[dict]:
    """Tilt and threshold of every source from a narrow table ``(__src, size, u)``; one row a source is held here."""
    counts = scratch.keep(docs.groupBy("__src", "size").agg(F.count("*").alias("docs")), "counts")
    per_source = counts.groupBy("__src").agg(F.sum(F.col("docs") * F.col("size")).alias("s"),
                                             F.sum("docs").alias("n")).collect()
    per_source.sort(key=lambda r: (r["__src"] is None, r["__src"] or ""))
    goal = targets([r["s"] for r in per_source], [weights[i % len(weights)] for i in range(len(per_source))], limit)
    state = [{"__source": r["__src"], "source_size": r["s"], "target": g, "mean": max(r["s"] / r["n"], 1e-9),
              "tilt": 0.0, "full": False, "low": -1.0, "width": 2.0, "need": 0.0, "extra": []} for r, g in zip(per_source, goal)]
    _newton(counts, state, limit)
    _thresholds(docs, state, limit)
    _fill(docs, state, limit)
    return state


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("__src"),
                       word_count(text_col).alias("size"), _uniform(id_col).alias("u"))


def _copies(limit: int) -> Column:
    rate = _rate(limit)
    more = (F.floor(rate) < limit) & (F.col("u") - (rate - F.floor(rate)) < F.col("low"))
    extra = F.array_contains("extra", F.col("u"))
    return F.least(F.lit(limit), F.floor(rate) + more.cast("long") + extra.cast("long")).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, rate, copies, taken``.

    Size is the number of words (0 for null or empty texts; such documents give 0 words at any rate). Sources are
    ordered by code point, the null source last, and weigh ``weights`` in turn. A document is taken 0 to ``limit``
    times; the same input gives the same copies on every run, and rows repeated with one identifier and size are taken
    alike. Null identifiers share one hash. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    narrow = scratch.keep(_narrow(docs, id_col, text_col, source_col), "sizes")
    state = solve(narrow, scratch, id_col, source_col, weights, limit)
    out = _with_sources(narrow, state).withColumn("rate", _rate(limit)).withColumn("copies", _copies(limit))
    return out.select("doc_id", F.col("__src").alias("source"), "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    state = solve(scratch.keep(_narrow(docs, id_col, text_col, source_col), "sizes"), scratch, id_col, source_col,
                  weights, limit)
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    held = held.select("__row", F.col(f"__row.`{source_col}`").cast("string").alias("__src"),
                       word_count(f"__row.`{text_col}`").alias("size"), _uniform(f"__row.`{id_col}`").alias("u"))
    taken = _with_sources(held, state).withColumn("__n", _copies(limit)).filter("__n > 0")
    repeated = taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return repeated.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
