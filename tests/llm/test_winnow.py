"""Decontamination against windows as they read."""

import collections
import hashlib
import random
import re

import pytest

from simlattice.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return WORD.findall(lower)


def expected(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i:i + size])].add("" if item is None else str(item))
    out = collections.Counter()
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc, len(w), len(hit), len(found), digest, bool(hit)] += 1
    return out


def got(df):
    return collections.Counter(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                                                           "contaminated").collect())


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é2", "naïve", "x", "Straße", "0", "ha", "über", "sum"]
    text = lambda n, v=vocabulary: rng.choice([" ", ", ", "\n", "-_"]).join(rng.choice(v) for _ in range(n))
    items = [(k, text(rng.choice([10, 11, 12, 25, 40]))) for k in range(30)]
    items += [(None, text(14)), (None, text(13)), (3, text(12)), (50, "a " * 30), (51, ""), (52, None), (53, "?!"),
              (54, "rare word"), (55, text(4)), (56, items[0][1]), (57, text(9))]
    docs = [(k, text(rng.choice([0, 1, 5, 9, 10, 60]))) for k in range(60)]
    for k in range(60):
        w = words(items[rng.randrange(30)][1])
        a, n = rng.randrange(len(w)), rng.choice([8, 9, 10, 11, 30])
        docs.append((rng.choice([None, k]), text(rng.randrange(8)) + " " + " ".join(w[a:a + n]).upper() + "." + text(rng.randrange(8))))
    docs += [(70, "A " * 300), (71, "b a " * 20), (72, "the RARE-word " * 3000), (73, None), (74, ""), (None, None), (70, "A " * 300)]
    return docs, items


@pytest.mark.parametrize("bound", [winnow.BROADCAST_ROWS, 0])
def test_decontaminate(spark, bound):
    docs, items = case(4)
    frame = spark.createDataFrame([(*d, 1, "q", [2]) for d in docs], "doc_id long, text string, n int, sig string, words array<int>")
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, win int")
    assert got(winnow.decontaminate(frame, bench, broadcast_rows=bound)) == expected(docs, items)


def test_empty_tables(spark):
    docs, items = case(5)
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(winnow.decontaminate(frame, none_i)) == expected(docs, [])
    assert winnow.decontaminate(none_d, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_every_shared_span_is_found(spark):
    rng = random.Random(9)
    item = [f"i{rng.randrange(30)}" for _ in range(80)]
    docs = []
    for a in range(70):
        docs.append((a, " ".join(["before"] * (a % 7) + item[a:a + 10] + ["after"] * (a % 5))))
        docs.append((1000 + a, " ".join(["before"] * (a % 7) + item[a:a + 9] + ["after"] * (a % 5))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    out = winnow.decontaminate(frame, bench).collect()
    assert {r.doc_id for r in out if r.contaminated} == set(range(70))
    assert all(r.n_hit == 10 for r in out if r.contaminated)
