"""Quality by ordinal cumulative-link regression on graded ratings.

A text's score is the sum, over its words, of hashed weights, divided by the root of their number: one for the word's letters (lower-cased, without
punctuation), one for its beginning and one for its shape (classes of its characters, runs collapsed). All grades share the weights;
``P(grade <= k) = 1 / (1 + exp(score - threshold_k))`` with thresholds kept in order. Expected grade and tail
probabilities follow. Training minimises the penalised likelihood by L-BFGS: each evaluation is one distributed pass
over the hashed rows of all rated documents, summed to one gradient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows, text_bytes, whole_row
from .words import IS_SPACE, LOWER, mix, powers

BITS = 18
#: Features a word, and bytes of the word's beginning that make one of them.
PER_WORD = 3
HEAD = 5
SLICE_BYTES = 1 << 20
#: Ratings that are broadcast to the documents (about 30 MB); more are dealt with them by identifier.
BROADCAST_RATINGS = 1_000_000
#: Least number of tasks of a training pass; a cluster with more cores has as many as these.
TRAIN_TASKS = 6
SCALE = 3.0
PENALTY = 2e-5
MAX_STEPS = 50
#: A document stays when the probability of the top grade reaches the cut: this share of the top-grade documents kept
#: out of the fit reaches it. Every ``HELD_PARTS``-th rated document, by a hash of its identifier, is kept out.
RETAIN = 0.99
HELD_PARTS = 5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(256) if chr(c).isalnum() or c >= 128]] = True
_RANDOM = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(77003))


def _run_hash(data: np.ndarray, use: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of the used bytes of each word; ``bounds`` are pairs of word starts and ends."""
    kept = np.concatenate([[0], np.cumsum(use)])
    values = _RANDOM[data[use]]
    power, inverse = powers(len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:len(values)])])
    start, end = kept[bounds[:, 0]], kept[bounds[:, 1]]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices of all words (three a word), and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    bounds = edge.reshape(-1, 2)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    counts = np.diff(np.searchsorted(bounds[:, 0], first))
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[:, 0]] = True
    top = np.uint64(64 - bits)
    word = _run_hash(LOWER[data], _LETTER[data], bounds) >> top
    shape = mix(_run_hash(kind, new & ~space, bounds) + np.uint64(1)) >> top
    head = np.stack([bounds[:, 0], np.minimum(bounds[:, 0] + HEAD, bounds[:, 1])], axis=1)
    head = mix(_run_hash(LOWER[data], _LETTER[data], head) + np.uint64(2)) >> top
    return np.stack([word, shape, head], axis=1).astype(np.int64).ravel(), counts


def _rows_of(texts: list[bytes], bits: int) -> list[tuple[bytes, bytes]]:
    """Per text the distinct features and their counts over the root of its words, times ``SCALE``."""
    index, counts = features(texts, bits)
    out, at = [], 0
    for n in counts.tolist():
        which, times = np.unique(index[at:at + PER_WORD * n], return_counts=True)
        at += PER_WORD * n
        out.append((which.astype(np.int32).tobytes(), (times * (SCALE / max(n, 1) ** 0.5)).astype(np.float32).tobytes()))
    return out


def _featurise(bits: int):
    schema = pa.schema([("grade", pa.int32()), ("at", pa.binary()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, texts in rows(batches, SLICE_BYTES):
            at, value = zip(*_rows_of(texts, bits))
            yield pa.RecordBatch.from_pydict({"grade": other["grade"], "at": at, "value": value}, schema=schema)
    return run


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then positive steps."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _likelihood(params, n_grades: int, bits: int):
    """One row a task: loss and gradient (weights and thresholds) of its rated rows."""
    schema = pa.schema([("loss", pa.float64()), ("n", pa.int64()), ("gradient", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = params.value
        weights, cut = value[:1 << bits], thresholds(value[1 << bits:])
        upper, lower = np.append(cut, np.inf), np.insert(cut, 0, -np.inf)
        gradient, by_cut, loss, n = np.zeros(1 << bits), np.zeros(n_grades + 1), 0.0, 0
        for batch in batches:
            size = np.array([len(x) // 4 for x in batch.column("at").to_pylist()], np.int64)
            at = np.frombuffer(b"".join(batch.column("at").to_pylist()), np.int32)
            x = np.frombuffer(b"".join(batch.column("value").to_pylist()), np.float32).astype(float)
            row = np.repeat(np.arange(len(size)), size)
            score = np.bincount(row, weights[at] * x, minlength=len(size))
            g = batch.column("grade").to_numpy(zero_copy_only=False)
            pu, pl = _sigmoid(upper[g] - score), _sigmoid(lower[g] - score)
            p = np.maximum(pu - pl, 1e-12)
            loss -= np.log(p).sum()
            n += len(g)
            du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
            gradient += np.bincount(at, ((du - dl)[row]) * x, minlength=1 << bits)
            by_cut[:n_grades] -= np.bincount(g, du, minlength=n_grades)
            by_cut[:n_grades] += np.bincount(g - 1 + (g == 0) * n_grades, np.where(g > 0, dl, 0), minlength=n_grades)
        if n:
            steps = np.exp(value[(1 << bits) + 1:])
            inner = by_cut[:n_grades - 1]
            raw = np.concatenate([[inner.sum()], steps * np.cumsum(inner[::-1])[::-1][1:]])
            yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [n],
                                              "gradient": [pa.compress(np.concatenate([gradient, raw]).tobytes(), "zstd",
                                                                       asbytes=True)]}, schema=schema)
    return run


def minimise(function, x: np.ndarray, max_steps: int = MAX_STEPS, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; ``function`` gives value and gradient. Past steps are held in single precision."""
    value, g = function(x)
    steps, changes = [], []
    for _ in range(max_steps):
        if np.abs(g).max(initial=0) < 1e-6:
            break
        d, alphas = -g, []
        for s, y in zip(reversed(steps), reversed(changes)):
            a = s @ d / (y @ s)
            alphas.append(a)
            d = d - a * y
        if steps:
            d *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
        for (s, y), a in zip(zip(steps, changes), reversed(alphas)):
            d = d + (a - y @ d / (y @ s)) * s
        rate = 1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())
        for _ in range(12):
            new_value, new_g = function(x + rate * d)
            if new_value <= value + 1e-4 * rate * (g @ d):
                break
            rate /= 4
        else:
            break
        s, y = rate * d, new_g - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory:], s.astype(np.float32)]
            changes = [*changes[1 - memory:], y.astype(np.float32)]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        x, value, g = x + s, new_value, new_g
        if done:
            break
    return x


def fit(rated: DataFrame, n_grades: int, bits: int = BITS, penalty: float = PENALTY) -> np.ndarray:
    """Parameters from ``rated(grade int, text binary)``: hashed weights, then raw thresholds."""
    spark = rated.sparkSession
    scratch = Scratch(spark, "quality")
    tasks = max(TRAIN_TASKS, spark.sparkContext.defaultParallelism)
    hashed = scratch.keep(rated.mapInArrow(_featurise(bits), "grade int, at binary, value binary")
                          .coalesce(tasks), "hashed", "zstd").coalesce(tasks)
    share = {r["grade"]: r["n"] for r in hashed.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    n = sum(share.values())
    below = np.cumsum([share.get(k, 0) for k in range(n_grades)])[:-1]
    cut = np.log((below + 0.5) / (n - below + 0.5))
    start = np.concatenate([np.zeros(1 << bits), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])

    def function(x):
        params = spark.sparkContext.broadcast(x)
        parts = hashed.mapInArrow(_likelihood(params, n_grades, bits), "loss double, n long, gradient binary").collect()
        params.destroy()
        # a task's gradient is zero at all features its rows lack, so it is small until it is added
        gradient = np.zeros(len(x))
        for p in parts:
            gradient += np.frombuffer(pa.decompress(bytes(p["gradient"]), x.nbytes, "zstd"))
        gradient /= n
        weights = x[:1 << bits]
        gradient[:1 << bits] += penalty * weights
        return sum(p["loss"] for p in parts) / n + penalty / 2 * weights @ weights, gradient

    out = minimise(function, start)
    scratch.drop("hashed")
    return out


def _score(params, n_grades: int, bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected_grade", pa.float64()),
                        ("tail", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = params.value
        weights, cut = value[:1 << bits], thresholds(value[1 << bits:])
        for other, texts in rows(batches, SLICE_BYTES):
            index, counts = features(texts, bits)
            total = np.concatenate([[0.0], np.cumsum(weights[index])])
            end = PER_WORD * np.cumsum(counts)
            score = SCALE * (total[end] - total[end - PER_WORD * counts]) / np.sqrt(np.maximum(counts, 1))
            tail = _sigmoid(score[:, None] - cut[None, :])
            yield pa.RecordBatch.from_pydict({"doc_id": other["doc_id"], "score": score,
                                              "expected_grade": tail.sum(axis=1), "tail": tail.tolist()}, schema=schema)
    return run


def rated_rows(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(grade, text, held)`` of every rated document.

    Ratings with a null identifier or grade take no part; of several ratings of one document the lowest counts.
    """
    graded = ratings.select(F.col("doc_id").cast("long").alias("__id"), F.col("grade").cast("int").alias("grade"))
    graded = graded.dropna().groupBy("__id").agg(F.min("grade").alias("grade"))
    if graded.count() <= BROADCAST_RATINGS:
        graded = F.broadcast(graded)
    found = docs.select(F.col(id_col).cast("long").alias("__doc"), text_bytes(text_col).alias("text"))
    held = F.pmod(F.xxhash64("__id", F.lit("held")), F.lit(HELD_PARTS)) == 0
    return found.join(graded, F.col("__doc") == F.col("__id")).select("grade", "text", held.alias("held"))


def learn(rated: DataFrame, retain: float = RETAIN):
    """Parameters, number of grades and cut from :func:`rated_rows`; None with fewer than two grades.

    The cut is the tail probability that ``retain`` of the top-grade documents kept out of the fit reach; without such
    documents 0.5. Where the documents of the fit lack a grade, all rated documents are fitted and give the cut.
    """
    spark = rated.sparkSession
    found = {(r["grade"], r["held"]) for r in rated.select("grade", "held").distinct().collect()}
    all_grades = {g for g, _ in found}
    if len(all_grades) < 2 or min(all_grades) < 0:
        return None
    n_grades = max(all_grades) + 1
    split = {g for g, held in found if not held} == all_grades and (n_grades - 1, True) in found
    fitted, apart = (rated.filter("not held"), rated.filter("held")) if split else (rated, rated)
    params = spark.sparkContext.broadcast(fit(fitted, n_grades))
    top = score_quality_rows(apart.filter(F.col("grade") == n_grades - 1), params, "text")
    cut = top.agg(F.percentile("tail", 1 - retain)).first()[0]
    return params, n_grades, 0.5 if cut is None else cut


def score_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  retain: float = RETAIN) -> DataFrame:
    """One row per input row: ``doc_id, score, expected_grade, tail_probability, kept``.

    ``ratings(doc_id, grade)`` has grades 0..G-1. ``tail_probability`` is that of the top grade; ``kept`` is whether it
    reaches the cut of ``learn``. Null and empty texts have score 0. With fewer than two grades among the rated documents nothing
    can be learned: score, grade and probability are null and every document is kept. Repeated rows are each scored;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rated = Scratch(spark, "quality").keep(rated_rows(docs, ratings, id_col, text_col), "rated", "zstd")
    learned = learn(rated, retain)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    if learned is None:
        none = F.lit(None).cast("double")
        return source.select("doc_id", none.alias("score"), none.alias("expected_grade"),
                             none.alias("tail_probability"), F.lit(True).alias("kept"))
    params, n_grades, cut = learned
    scored = source.mapInArrow(_score(params, n_grades, BITS),
                               "doc_id long, score double, expected_grade double, tail array<double>")
    top = F.element_at("tail", -1)
    return scored.select("doc_id", "score", "expected_grade", top.alias("tail_probability"), (top >= F.lit(cut)).alias("kept"))


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings from ``labels(doc_id, quality, toxic)``: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 2).alias("grade"))


def keep_good(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              retain: float = RETAIN) -> DataFrame:
    """The rows of ``docs`` (all columns, of any name) that the classifier keeps; each row is judged by its own text.

    A null text is judged as an empty one; without ratings, or with one grade only, all rows stay.
    """
    spark = docs.sparkSession
    rated = Scratch(spark, "quality").keep(rated_rows(docs, ratings, id_col, text_col), "rated", "zstd")
    learned = learn(rated, retain)
    if learned is None:
        return docs
    params, _, cut = learned
    scored = score_quality_rows(docs, params, text_col)
    return scored.filter(F.col("tail") >= F.lit(cut)).select("row.*")


def score_quality_rows(docs: DataFrame, params, text_col: str) -> DataFrame:
    """Each row of ``docs`` as ``row``, and ``tail``, the probability of the top grade."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def tail(texts: pa.Array) -> pa.Array:
        value = params.value
        weights, cut = value[:1 << BITS], thresholds(value[1 << BITS:])
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        out = []
        for _, part in rows(iter([batch]), SLICE_BYTES):
            index, counts = features(part, BITS)
            total = np.concatenate([[0.0], np.cumsum(weights[index])])
            end = PER_WORD * np.cumsum(counts)
            score = SCALE * (total[end] - total[end - PER_WORD * counts]) / np.sqrt(np.maximum(counts, 1))
            out.append(_sigmoid(score - cut[-1]))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    text = F.col(text_col) if dict(docs.dtypes)[text_col] == "binary" else text_bytes(text_col)
    return docs.select(whole_row(docs).alias("row"), tail(text).alias("tail"))
