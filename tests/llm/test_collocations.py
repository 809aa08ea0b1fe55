"""Collocations against plain counting, and the transducers against the n-grams they hold."""

import collections
import random
import re

import numpy as np
import pytest

from simlattice.llm import collocations as C


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def counted(docs):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def expected(docs, least, top):
    f, n = counted(docs)
    f = {k: a for k, a in f.items() if a >= least}
    rows = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        longer = any(q[0] == lang and len(q[1]) > len(p) and b >= a and any(q[1][i:i + len(p)] == p for i in range(4))
                     for q, b in f.items())
        if not longer:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                        for k in range(1, len(p)))
            rows[lang].append((-score, -a, " ".join(p).encode(), left, right))
    out = set()
    for lang, found in rows.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "the", "The", "Éa", "éa", "x-y", "\x00", "zz z", "straße"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = []
    for k in range(n):
        text = ""
        for w in rng.choices(vocabulary, weights, k=rng.choice([0, 1, 3, 40, 120])):
            text += w + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b", " - "])
        docs.append((rng.choice(["en", "fr", None, "und"]), text))
    docs += [("en", "of the people by the people, " * 50), ("de", None), ("de", ""), ("de", "!?"), ("fr", "a " * 3000)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k % 7, t, lang, 1, "x") for k, (lang, t) in enumerate(docs)],
                                 "doc_id long, text string, lang string, count long, phrase string")


@pytest.mark.parametrize("sizes", [{}, {"slice_bytes": 2000, "range_bytes": 1500, "range_rows": 100}, {"bits": 4}])
def test_collocations(spark, sizes, monkeypatch):
    sizes = dict(sizes)
    if bits := sizes.pop("bits", None):  # a full sketch
        monkeypatch.setattr(C, "FEWEST_BITS", bits)
        monkeypatch.setattr(C, "MOST_BITS", bits)
    docs = corpus(3)
    out = C.collocations(frame(spark, docs), least=8, top=60, **sizes).collect()
    assert {tuple(r) for r in out} == expected(docs, 8, 60)
    assert len(out) == len({tuple(r) for r in out})


def test_none(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(frame(spark, corpus(1, 3)[:3])).count() == 0


def test_transducers():
    docs = corpus(8)
    tokens = [C.Tokens([lower(t).encode() for _, t in docs[k::5]], [lang or "und" for lang, _ in docs[k::5]]) for k in range(5)]
    slices = [C.Windows(t, np.full(512, 255, np.uint8), 12) for t in tokens]
    want, _ = counted(docs)
    for parts, hot in ((1, np.zeros(0, np.uint64)), (7, None)):
        if hot is None:  # all prefixes of one and two words that start 300 windows
            size = collections.Counter()
            for w in slices:
                for j, prefix in enumerate(w.prefixes()):
                    if j < 2:
                        size.update(prefix.tolist())
            hot = np.sort(np.array([p for p, s in size.items() if s > 60], np.uint64))
            assert len(hot) > 3
        by_part, found = collections.defaultdict(list), collections.Counter()
        for w in slices:
            cut = C.ranges(w, hot, parts)
            assert len({p for p, _ in cut}) == len(cut)
            for part, value in cut:
                by_part[part].append(value)
        for values in by_part.values():
            mine = list(C.union(values, hot, 1))
            assert parts == 1 or not any(r[4] for r in mine) or len(hot)
            for lang, phrase, k, count, _ in mine:
                assert len(phrase.split(" ")) == k
                found[lang, tuple(phrase.split(" "))] += count
        assert found == want
    levels = C.build(slices[0].rows, slices[0].weight, np.zeros(len(slices[0].rows), np.int64))
    assert len(levels[-1].label) < (slices[0].rows[:, -1] > 0).sum() / 2  # equal states are one
