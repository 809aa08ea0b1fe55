"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text (what is no letter counts as one space) are hashed; their
document frequencies come from all training documents. Weights are learned by follow-the-regularised-leader with L1 and
L2 penalties: shards of a bounded sample run in parallel and their states are averaged after every round. Logits are
then divided by a temperature fitted on documents kept out of that sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rows, text_bytes
from .words import mix

BITS = 15
LONGEST = 3
SLICE_BYTES = 1 << 20
#: Bound of the sample that the weights and the temperature are fitted on.
MAX_TRAIN = 8_000
#: Documents of each language that are drawn at least (all, where it has fewer), so no language is lost on a skewed corpus.
LEAST_TRAIN = 50
CALIBRATION_PARTS = 10
SHARDS = 6
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
UNKNOWN = "und"
_PLACE = mix(np.arange(11, 11 + LONGEST, dtype=np.uint64)) | np.uint64(1)
_SPREAD = mix(np.arange(51, 51 + LONGEST, dtype=np.uint64)) | np.uint64(1)


def _alphabet() -> np.ndarray:
    """Code point to its lower-cased letter, a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_TABLE: list[np.ndarray] = []


def grams_of(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """For each text its hashed n-grams, with repeats; none for a text without letters.

    A text counts as its letters, lower-cased, with one space for each run of other characters and at both ends.
    """
    if not _TABLE:
        _TABLE.append(_alphabet())
    plain = [t.decode("utf-8", "replace") for t in texts]
    code = np.frombuffer((" " + " ".join(plain) + " ").encode("utf-32-le"), np.uint32)
    code = _TABLE[0][code]
    space = code == 32
    kept = np.ones(len(code), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    place = np.cumsum(kept) - 1
    # the space before and after each text; texts share it
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in plain])])
    start, end = place[first[:-1]], place[first[1:]]
    code = code[kept].astype(np.uint64)
    hashes, held = [], np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        held = held[:len(code) - n + 1] + code[n - 1:] * _PLACE[n - 1]
        hashes.append(((held * _SPREAD[n - 1]) >> np.uint64(64 - bits)).astype(np.int64))
    return [np.concatenate([h[a:b + 1 - k] for k, h in enumerate(hashes)]) if b > a else np.zeros(0, np.int64)
            for a, b in zip(start.tolist(), end.tolist())]


def _training(bits: int):
    """Kind 0: document frequencies of the task; kind 1: rows of the sample as (feature, count)."""
    schema = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("held", pa.bool_()), ("lang", pa.string()),
                        ("shard", pa.int32()), ("at", pa.binary()), ("count", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, n = np.zeros(1 << bits, np.int64), 0
        for other, texts in rows(batches, SLICE_BYTES):
            out = {name: [] for name in schema.names}
            for k, found in enumerate(grams_of(texts, bits)):
                if not len(found):
                    continue
                if other["sampled"][k]:
                    at, count = np.unique(found, return_counts=True)
                    for name, v in zip(schema.names, (1, None, other["held"][k], other["lang"][k], other["shard"][k],
                                                      at.astype(np.int32).tobytes(), count.astype(np.int32).tobytes())):
                        out[name].append(v)
                else:
                    at = np.flatnonzero(np.bincount(found, minlength=1 << bits))
                frequency[at] += 1
                n += 1
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_pydict({
            "kind": [0], "n": [n], "held": [None], "lang": [None], "shard": [None],
            "at": [at.astype(np.int32).tobytes()], "count": [frequency[at].tobytes()]}, schema=schema)
    return run


def _add(bits: int):
    def run(table):
        total, n = np.zeros(1 << bits, np.int64), 0
        for at, count, k in zip(*(table.column(c).to_pylist() for c in ("at", "count", "n"))):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(count, np.int64)
            n += k
        return pa.table({"n": pa.array([n], pa.int64()), "count": pa.array([total.tobytes()], pa.binary())})
    return run


def _decode(at: bytes, count: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and unit-length TF-IDF values (1 + log of the count, times idf)."""
    where = np.frombuffer(at, np.int32)
    x = (1 + np.log(np.frombuffer(count, np.int32))) * idf[where]
    return where, x / max(np.sqrt(x @ x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a follow-the-regularised-leader state: zero where the sum of gradients is within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(state, langs: list[str], idf_of):
    """One round over one shard, from the shared state; gives the shard's state."""
    number = {x: k for k, x in enumerate(langs)}

    def run(table):
        z, n = (x.copy() for x in state.value)
        idf = idf_of.value
        order = np.argsort([hash_ for hash_ in table.column("order").to_pylist()], kind="stable")
        langs_, ats, counts = (table.column(c).to_pylist() for c in ("lang", "at", "count"))
        for i in order.tolist():
            where, x = _decode(ats[i], counts[i], idf)
            w = weights_of(z[where], n[where])
            p = _softmax(x @ w)
            p[number[langs_[i]]] -= 1
            g = x[:, None] * p[None, :]
            more = n[where] + g * g
            z[where] += g - (np.sqrt(more) - np.sqrt(n[where])) / ALPHA * w
            n[where] = more
        return pa.table({"z": pa.array([z.tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary()),
                         "rows": pa.array([len(order)], pa.int64())})
    return run


def _logits(weights, idf_of, langs):
    number = {x: k for k, x in enumerate(langs)}

    def run(batches):
        w, idf = weights.value, idf_of.value
        for batch in batches:
            z = []
            for at, count in zip(batch.column("at").to_pylist(), batch.column("count").to_pylist()):
                where, x = _decode(at, count, idf)
                z.append((x @ w[where]).tolist())
            truth = [number[x] for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_pydict({"truth": pa.array(truth, pa.int32()), "z": pa.array(z, pa.list_(pa.float64()))})
    return run


def temperature(z: np.ndarray, truth: np.ndarray) -> float:
    """Divisor of the logits with the greatest likelihood, by golden section on its logarithm."""
    if not len(z):
        return 1.0

    def loss(t):
        p = _softmax(z / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(z)), truth], 1e-300)).mean()
    low, high, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, weights (feature x language), idf and temperature."""

    def __init__(self, langs, weights, idf, divisor):
        self.langs, self.weights, self.idf, self.divisor = langs, weights, idf, divisor

    def predict(self, found: np.ndarray) -> tuple[str, float]:
        """Language and probability of a text with these n-grams."""
        if not len(found) or not self.langs:
            return UNKNOWN, 0.0
        count = np.bincount(found, minlength=1 << BITS)
        where = np.flatnonzero(count)
        x = (1 + np.log(count[where])) * self.idf[where]
        p = _softmax((x @ self.weights[where]) / max(np.sqrt(x @ x), 1e-12) / self.divisor)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def train(docs: DataFrame, scratch: Scratch, max_train: int = MAX_TRAIN) -> Model:
    """Model from ``docs(doc_id, text, lang)``; the caller leaves out what must not be learned from."""
    spark = docs.sparkSession
    labelled = docs.filter("lang IS NOT NULL")
    # each language has its share of the sample, but LEAST_TRAIN at least; rows are drawn by identifier and text
    counts = labelled.groupBy("lang").agg(F.count("*").alias("of_lang"))
    total = counts.agg(F.sum("of_lang")).first()[0] or 1
    labelled = labelled.join(counts, "lang")
    draw = lambda k: F.xxhash64("doc_id", "text", F.lit(k))
    quota = F.greatest(F.lit(LEAST_TRAIN) / F.col("of_lang"), F.lit(max_train / total))
    sampled = F.pmod(draw(5), F.lit(1 << 30)) < F.least(quota, F.lit(1.0)) * (1 << 30)
    held = (F.pmod(draw(6), F.lit(CALIBRATION_PARTS)) == 0) & (F.col("of_lang") > 2 * CALIBRATION_PARTS)
    source = labelled.select(
        text_bytes().alias("text"), "lang", sampled.alias("sampled"), held.alias("held"),
        F.pmod(draw(7), F.lit(SHARDS)).cast("int").alias("shard"))
    kept = scratch.keep(source.mapInArrow(
        _training(BITS), "kind int, n long, held boolean, lang string, shard int, at binary, count binary"), "training")
    # two sums: tasks to SHARDS groups, groups to one; each row is one vector of the model's size
    part = F.pmod(F.xxhash64("at"), F.lit(SHARDS))
    frequency = kept.filter("kind = 0").groupBy(part.alias("p")).applyInArrow(_add(BITS), "n long, count binary").collect()
    n = sum(r["n"] for r in frequency)
    df = sum(np.frombuffer(r["count"], np.int64) for r in frequency) if frequency else np.zeros(1 << BITS)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = kept.filter("kind = 1")
    fitted = sample.filter("NOT held")
    langs = sorted(r["lang"] for r in fitted.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), idf, 1.0)
    idf_of = spark.sparkContext.broadcast(idf)
    state = np.zeros((1 << BITS, len(langs))), np.zeros((1 << BITS, len(langs)))
    shards = fitted.select("shard", "lang", "at", "count", F.xxhash64("at", "count", "lang").alias("order"))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(state)
        found = shards.groupBy("shard").applyInArrow(_learn(shared, langs, idf_of), "z binary, n binary, rows long").collect()
        size = sum(r["rows"] for r in found)
        state = tuple(sum(np.frombuffer(r[c]) * (r["rows"] / size) for r in sorted(found, key=lambda r: r["z"]))
                      .reshape(1 << BITS, len(langs)) for c in ("z", "n"))
        shared.destroy()
    weights = weights_of(*state)
    shared = spark.sparkContext.broadcast(weights)
    known = sample.filter("held").filter(F.col("lang").isin(langs)).select("lang", "at", "count")
    logits = known.mapInArrow(_logits(shared, idf_of, langs), "truth int, z array<double>").collect()
    divisor = temperature(np.array([r["z"] for r in logits]).reshape(-1, len(langs)),
                          np.array([r["truth"] for r in logits], np.int64))
    return Model(langs, weights, idf, divisor)


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, texts in rows(batches, SLICE_BYTES):
            lang, score = zip(*map(model.value.predict, grams_of(texts)))
            yield pa.RecordBatch.from_pydict({"doc_id": other["doc_id"], "lang_pred": lang, "score": score}, schema=schema)
    return run


def held_out(id_col: str, parts: int):
    """Whether crc32 of the identifier as text is divisible by ``parts`` (a null identifier counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Training reads text and non-null language of documents that are not held out. ``lang_pred`` is a language seen in
    training, ``und`` with score 0 for texts without a letter (null and empty ones too), and for all texts where
    nothing can be learned. Ties go to the language first in order. Repeated rows are each predicted, other columns
    ignored; an empty table gives an empty result. The same input gives the same model on every run.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                         F.col(lang_col).cast("string").alias("lang"), held_out(id_col, 5).alias("held_out"))
    model = spark.sparkContext.broadcast(train(source.filter("NOT held_out"), Scratch(spark, "langid"), max_train))
    found = source.select("doc_id", text_bytes().alias("text")).mapInArrow(
        _predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")
