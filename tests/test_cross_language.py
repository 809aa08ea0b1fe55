"""Cross-language pairs and windows against brute force."""

import random

from simlattice.operators.pairs import cross_language_pairs, set_candidates


def rows(seed, n=120):
    rng = random.Random(seed)
    tokens = [f"t{k}" for k in range(14)]
    # t0 is in nearly every set
    return [(k, rng.choice(["python", "java", "cpp", "text"]), sorted({"t0", *rng.sample(tokens, rng.choice([0, 1, 3, 6]))})
             if k % 11 else []) for k in range(n)]


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def test_cross_language_pairs(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "item_id long, language string, pset array<string>")
    for t in (0.3, 0.6, 1.0):
        want = {}
        for i, la, a in data:
            for j, lb, b in data:
                if la < lb and a and b and jaccard(a, b) >= t:
                    key = la, lb, tuple(a), tuple(b)
                    i0, j0, n = want.get(key, (i, j, 0))
                    want[key] = min(i, i0), min(j, j0), n + 1
        got = {(r.lang1, r.lang2, r.item_a, r.item_b, r.n_pairs): r for r in cross_language_pairs(df, t).collect()}
        assert set(got) == {(la, lb, i, j, n) for (la, lb, _, _), (i, j, n) in want.items()}
        for r in got.values():
            assert r.n_pairs == r.n_a * r.n_b and r.structural_similarity >= t
    assert cross_language_pairs(df.filter("language = 'java'")).count() == 0
    assert cross_language_pairs(df.limit(0)).count() == 0


def test_candidates_hold_every_pair(spark):
    data = rows(5, 90)
    df = spark.createDataFrame([(k, s) for k, _, s in data], "k long, s array<string>")
    for t in (0.2, 0.6, 0.9):
        found = {(r.k_l, r.k_r) for r in set_candidates(df, "k", "s", t).collect()}
        want = {(i, j) for i, _, a in data for j, _, b in data if i < j and a and b and jaccard(a, b) >= t}
        assert want <= found


def test_windows_cross_chunks(spark):
    from simlattice.plans.sequences import sequence_shingles
    rng = random.Random(4)
    items = {k: [rng.choice("abc") for _ in range(n)] for k, n in enumerate([1, 2, 3, 7, 8, 9, 50])}
    df = spark.createDataFrame([(k, p, t) for k, seq in items.items() for p, t in enumerate(seq)],
                               "item_id long, pos long, node_type string")
    for k, chunk in ((3, 4), (4, 8), (3, 4096)):
        want = set()
        for item, seq in items.items():
            if len(seq) < k:
                want.add((item, 0, " ".join(seq)))
            want |= {(item, p, " ".join(seq[p:p + k])) for p in range(len(seq) - k + 1)}
        out = [tuple(r) for r in sequence_shingles(df, k, chunk).collect()]
        assert len(out) == len(want) and set(out) == want
