"""Exact candidate generation: pruned results equal brute force."""

import itertools
import random

from pyspark.sql import functions as F


def _texts(seed=7, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(3, 30))] for _ in range(12)]
    # same word bigram set, different word order -> same pattern set, different hash
    base.append(["w1", "w2", "w1", "w3", "w1", "w2"])
    base.append(["w1", "w3", "w1", "w2", "w1", "w2"])
    out = []
    for _ in range(n):
        b = list(rnd.choice(base))
        r = rnd.random()
        if r < 0.3 and b:
            b[rnd.randrange(len(b))] = rnd.choice(vocab)
        elif r < 0.4:
            b = b + [rnd.choice(vocab)]
        elif r < 0.45:
            b = []
        out.append(" ".join(b))
    return out


def _brute(rows, t):
    def verdict(a, b):
        dist = bin(int(a.hash_hex, 16) ^ int(b.hash_hex, 16)).count("1")
        syn = 1 - dist / 256
        ea, eb = len(a.patterns) == 0, len(b.patterns) == 0
        if ea and eb:
            st = 1.0
        elif ea or eb:
            st = 0.0
        else:
            sa, sb = set(a.pset), set(b.pset)
            st = len(sa & sb) / len(sa | sb)
        return max(syn, st)
    return {(a.item_id, b.item_id) for a, b in itertools.combinations(sorted(rows, key=lambda r: r.item_id), 2)
            if verdict(a, b) >= t}


def test_all_pairs_equals_brute_force(spark):
    from simlattice.operators.pairs import all_pairs, expand_pairs
    from simlattice.operators.structure import fingerprint_items
    texts = _texts()
    items = spark.createDataFrame([(i, "text", s) for i, s in enumerate(texts)], "item_id long, language string, code string")
    fp = fingerprint_items(items, languages=["text"]).persist()
    rows = fp.collect()
    for t in (0.9, 0.88):                     # thresholds the exact planner accepts
        grouped = all_pairs(fp, t, syn_t=t)
        listed = [(r.item_a, r.item_b) for r in expand_pairs(grouped, fp).collect()]
        got = set(listed)
        assert len(listed) == len(got)                          # no pair is reported twice
        assert got == _brute(rows, t)
        total = grouped.agg(F.sum("n_pairs")).collect()[0][0]
        assert total == len(got)


def test_band_candidates_find_all_close_hashes(spark):
    from simlattice.operators.pairs import hamming_bound, hash_candidates
    rnd = random.Random(3)
    hexes = []
    for _ in range(30):
        h = rnd.getrandbits(256)
        hexes.append(h)
        for _ in range(2):
            m = h
            for bit in rnd.sample(range(256), rnd.randint(0, 25)):
                m ^= 1 << bit
            hexes.append(m)
    hexes = [f"{h:064x}" for h in hexes]
    df = spark.createDataFrame(list(enumerate(hexes)), "k long, h string")
    for t in (0.9, 0.95, 0.99):                  # radius-1 and radius-0 band layouts
        d = hamming_bound(t)
        got = {(r.k_l, r.k_r) for r in hash_candidates(df, "k", "h", d).collect()}
        want = {(i, j) for i, j in itertools.combinations(range(len(hexes)), 2)
                if bin(int(hexes[i], 16) ^ int(hexes[j], 16)).count("1") <= d}
        assert want and want <= got


def test_prefix_filter_candidates_are_complete(spark):
    from simlattice.operators.pairs import set_candidates
    rnd = random.Random(11)
    sets = [sorted({f"t{rnd.randint(0, 15)}" for _ in range(rnd.randint(1, 10))}) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "k long, s array<string>")
    for t in (0.3, 0.6, 0.9):
        got = {(r.k_l, r.k_r) for r in set_candidates(df, "k", "s", t).collect()}
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
                if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= t}
        assert want <= got


def test_low_syntactic_threshold_is_refused(spark):
    import pytest
    from simlattice.operators.pairs import check_hash_threshold
    assert check_hash_threshold(0.9) == 25
    with pytest.raises(ValueError):
        check_hash_threshold(0.5)


def test_search_batch_of_one_equals_batch_row(spark):
    from simlattice.operators import search as S
    from simlattice.operators.structure import fingerprint_items
    texts = _texts(seed=5, n=40)
    items = spark.createDataFrame([(i, "text", s) for i, s in enumerate(texts)], "item_id long, language string, code string")
    fp = fingerprint_items(items, languages=["text"]).persist()
    bank = fp.withColumnRenamed("item_id", "id")
    queries = fp.filter(F.col("item_id") < 8).withColumnRenamed("item_id", "query_id")
    allhits = {(r.query_id, r.id, r.similarity) for r in S.search_combined(queries, bank, 0.9, 5, syn_t=0.9).collect()}
    one = {(r.query_id, r.id, r.similarity)
           for r in S.search_combined(queries.filter(F.col("query_id") == 3), bank, 0.9, 5, syn_t=0.9).collect()}
    assert one == {h for h in allhits if h[0] == 3}
    st = S.search_structural(queries, bank, 0.5, 100).collect()
    empty_ids = {r.item_id for r in fp.collect() if len(r.patterns) == 0}
    assert not any(r.id in empty_ids for r in st)          # rows without patterns are skipped
    comb = S.search_combined(queries, bank, 0.9, 5, syn_t=0.9).collect()
    for r in comb:
        if r.match_type == "syntactic" and r.structural_similarity == 0.0:
            assert r.matching_patterns is None               # hash-only hits carry no patterns
