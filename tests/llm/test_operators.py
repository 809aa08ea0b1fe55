"""Each training-data operator against a brute-force version, on a small table with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.llm import (ann, exact_dedup, langid, mixing, nbest, ngram_join, pst, quality, token_store, url_filter)
from simlattice.llm.queries import BYTE_BPE, PIECES

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(LOW))


BASE = "the quick brown fox jumps over a lazy dog and runs far away from every other animal in these woods today"
TEXTS = [(1, BASE), (2, BASE), (3, BASE.upper()), (4, BASE + " again"), (5, None), (6, ""), (7, " \n\t "), (8, "one two"),
         (9, "One  TWO"), (10, "lorem ipsum dolor sit amet"), (11, "  a  b \n c é\u00a0ü 漢字 🙂 "), (12, "z" * 3000),
         (None, BASE), (13, "lorem ipsum dolor sit amet"), (13, "lorem ipsum dolor sit amet"), (13, "other text here"),
         (14, "word " * 4000), (15, BASE + " " + BASE[::-1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 3 else "fr", [None, "a", "b"][k % 3], 0, "x", 1.0) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept string, n double")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    by = collections.defaultdict(list)
    for i, t in TEXTS:
        by[t or ""].append(i)
    for keep, pick in (("min", min), ("max", max)):
        want = collections.Counter()
        for i, t in TEXTS:
            ids = by[t or ""]
            owner = pick([x for x in ids if x is not None], default=None)
            want[i, owner, len(ids), i == owner, hashlib.sha256((t or "").encode()).hexdigest()] += 1
        for budget in (exact_dedup.TRIE_BYTES, 40):  # a small budget spills at nearly every row
            out = exact_dedup.exact_dedup(docs, keep=keep, trie_bytes=budget).collect()
            assert collections.Counter(map(tuple, out)) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(t or "" for t in (r.text for r in kept.collect())) == collections.Counter(set(by))


def test_patricia_trie():
    rng = np.random.default_rng(3)
    trie, want = exact_dedup.PatriciaTrie(max), {}
    for k in range(3000):
        key = bytes(rng.integers(0, 3, rng.integers(0, 9)).astype(np.uint8))
        trie.insert(key, k)
        want[key] = (k, want.get(key, (0, 0))[1] + 1)
    first = dict((k, (o, c)) for k, o, c, _ in trie.take(b"\x01"))
    assert first == {k: v for k, v in want.items() if k < b"\x01"}
    rest = dict((k, (o, c)) for k, o, c, _ in trie.take())
    assert {**first, **rest} == want and trie.held == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = collections.Counter()
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out[d, len(sets[i]), min(ids, default=None) if sets[i] else d] += 1
    return out


def test_ngram_join(spark, docs, none):
    out = ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, out)) == brute_components(TEXTS)
    assert ngram_join.ngram_components(none).count() == 0
    rng = np.random.default_rng(5)
    rows = []
    for k in range(220):
        if k % 4 == 0 or k < 6:
            w = list(rng.integers(0, 60, rng.integers(8, 60)))
        else:
            w = list(rng.choice(6) and prev or prev)
            w[int(rng.integers(0, len(w)))] = 99
        prev = list(w)
        rows.append((k, " ".join(f"w{x}" for x in w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (ngram_join.TASK_SHINGLES, 60):  # a small bound deals groups in pairs of blocks
        out = ngram_join.ngram_components(df, task_shingles=size).select("doc_id", "n_shingles", "component_id").collect()
        assert collections.Counter(map(tuple, out)) == brute_components(rows)


def test_url_filter(spark):
    urls = ["http://example.com/en/x", "https://WWW.Example.com/en/1?q", "http://a.example.com/fr/", "x://a.net/fr/z#y",
            "http://net/es/", "http://b.net/de/", "http://badexample.com/en/", "example.com/en/", None, "", "http://",
            "http://example.com", "http://example.com?x=/en/", "ftp://xcom/", "http://www.example.com/EN/"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)] + [(0, urls[0], "r")],
                                  "page_id long, url string, rule string")

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = raw.encode().translate(LOW).decode(), re.match(r"[^?#]*", rest[len(raw):]).group()
        fit = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit)[1:]) if fit else (host, path, None, "allow")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()
    want = [(k, *judge(u)) for k, u in enumerate(urls)] + [(0, *judge(urls[0]))]
    assert collections.Counter(map(tuple, out)) == collections.Counter(want)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}


def test_nearest(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((600, 16)).round(3)
    x[200:420] = x[0]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 3), (None, x[1].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert len(found) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in found)
        assert found == sorted(found, key=lambda y: (-y[1], y[0]))
        hits += len(set(order) & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]


def test_nbest(docs, none):
    model = nbest.piece_model(PIECES)

    def all_paths(word):
        if not word:
            return [(0.0, ())]
        out = []
        for j, s in model.edges(word, 0):
            out += [(s + t, tuple(model.ids(word, 0, j)) + p) for t, p in all_paths(word[j:])]
        return out
    for text in ("a cat", "ab  c", "the cats", "é\nx", "🙂 ab"):
        want = sorted((s for s, _ in all_paths((" " + text).replace(" ", nbest.MARK))), reverse=True)[:4]
        ids, scores, changes = list(nbest.Encoder(model, 4).encode([text.encode()]))[0]
        assert scores == want
        seen = {tuple(ids)}
        for change in changes:
            other, shift = ids.tolist(), 0
            for at, n, new in change:
                other[at + shift:at + shift + n] = new
                shift += len(new) - n
            assert model.decode(other).decode() == text
            seen.add(tuple(other))
        assert len(seen) == len(scores)
    out = nbest.encode_n_best(docs, PIECES).collect()
    assert len(out) == len(TEXTS) and all(r.round_trip and len(r.ids) == r.n_pieces for r in out)
    assert {r.text_crc32 for r in out if r.doc_id == 14} == {zlib.crc32(b"word " * 4000)}
    assert nbest.encode_n_best(none, PIECES).count() == 0


def test_token_store(docs, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE_BPE)
    out = token_store.token_store(docs, BYTE_BPE, shard_bytes=4000).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start = 0
    for r, (i, t) in zip(out, order, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.token_store(none, BYTE_BPE).count() == 0
    keys = token_store.mix(np.arange(5000, dtype=np.uint64))
    index = token_store.PerfectHash.build(keys)
    assert sorted(index.find(keys)) == list(range(5000))


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(TEXTS)
    size = collections.Counter()
    for k, (i, t) in enumerate(TEXTS):
        size[[None, "a", "b"][k % 3]] += len(words(t))
    names = ["a", "b", None]
    goal = dict(zip(names, mixing.targets([size[n] for n in names], [5.0, 2.0, 1.0])))
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and r.taken <= 3 * r.size
    assert mixing.targets([100, 100, 1], [5.0, 2.0, 1.0]) == pytest.approx([198 * 5 / 7, 198 * 2 / 7, 3.0])
    assert mixing.mix_sources(none).count() == 0
    rows = [(k, "w " * (3 + k * 7 % 90), f"s{k % 4}") for k in range(800)]
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = collections.Counter(), {}
    for r in mixing.mix_sources(df).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)
    copies = collections.Counter(r.doc_id for r in mixing.take_mix(df).collect())
    want = {r.doc_id: r.copies for r in mixing.mix_sources(df).collect() if r.copies}
    assert dict(copies) == want and mixing.take_mix(docs).columns == docs.columns


def test_suffix_tree(spark, docs, none):
    out = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                              for r in pst.score_texts(docs).collect())
    train = [zlib.crc32(str("" if i is None else i).encode()) % 10 != 0 for i, _ in TEXTS]
    count = collections.Counter()
    for (_, t), use in zip(TEXTS, train):
        if use:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for (i, t), use in zip(TEXTS, train):
        tokens = [*words(t), None]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[i, not use, len(tokens), sum(count[w] > 0 for w in tokens), n, round(base, 6)] += 1
    assert out == want
    assert pst.score_texts(none).count() == 0
    # words that follow each other: the contexts must help on texts held out
    rng = np.random.default_rng(2)
    rows = [(k, " ".join(f"a{x} b{x}" for x in rng.integers(0, 40, 60))) for k in range(400)]
    got = pst.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert len(got) > 10 and all(r.score > 0.7 * r.base_score for r in got)


def test_suffix_tree_distribution():
    """In every state the probabilities of all words and the unseen symbol sum to one."""
    parent = np.array([0, 0, 1])
    tree = pst.SuffixTree(parent, [
        {"context": 0, "c": 100, "kinds": 3, "once": 1, "gain": 0.0}, {"context": 1, "c": 40, "kinds": 2, "once": 0, "gain": 500.0},
        {"context": 2, "c": 10, "kinds": 1, "once": 0, "gain": 500.0}], min_share=0.0, min_gain=0.0)

    class Group:
        total = np.array([60, 39, 1, 0])

        def __init__(self, context):
            self.word, self.context = np.arange(4), np.full(4, context)

        def of(self, word, context):
            by = {1: [30, 10, 0, 0], 2: [10, 0, 0, 0]}
            return np.array([self.total[w] if c == 0 else by[c][w] for w, c in zip(word, context)])
    for context in (0, 1, 2):
        assert abs((10.0 ** tree.log10(Group(context))).sum() - 1) < 1e-9


def test_language(spark, docs, none):
    rng = np.random.default_rng(9)
    parts = {"en": ["the", "ing", "and", "wh"], "fr": ["eau", "que", "é", "les"], "de": ["sch", "ung", "der", "ö"]}
    rows = []
    for k in range(900):
        lang = ["en", "fr", "de"][k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(3, 40))), lang))
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 !?", None), (None, "the anding", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in out:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert {r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert langid.identify(none).count() == 0


def test_quality(spark, docs, none):
    rng = np.random.default_rng(4)
    rows, ratings = [], []
    for k in range(600):
        clean = [f"word{x}" for x in rng.integers(0, 200, 30)]
        grade = k % 3
        text = " ".join(w + "###" for w in clean) if grade == 0 else " ".join(clean + ["nasty", "vile"] * (2 if grade == 1 else 0))
        rows.append((k, text, "s"))
        if k % 2:
            ratings.append((k, grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    rated = spark.createDataFrame(ratings + [(None, 1), (3, None)], "doc_id long, grade int")
    out = quality.score_quality(df, rated).collect()
    unseen = [r for r in out if r.doc_id % 2 == 0]
    assert sum(round(r.expected_grade) == r.doc_id % 3 for r in unseen) >= 0.95 * len(unseen)
    kept = quality.keep_good(df, rated)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.kept}
    assert quality.score_quality(none, rated).count() == 0
    odd = quality.score_quality(docs, rated.limit(0)).collect()
    assert len(odd) == len(TEXTS) and all(r.kept and r.score is None for r in odd)
