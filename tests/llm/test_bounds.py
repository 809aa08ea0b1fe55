"""Cases whose cost or result must not hang on the size of one host, cell or language."""

import numpy as np

from simlattice.llm import ann, langid, url_filter


def test_long_host(spark):
    host = "a." * 500_000 + "example.com"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://" + "." * 50_000 + "/en/"), (3, "http://a..com/")],
                                  "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    assert out == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("com/", "allow")}


def test_slices_and_blocks_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(ann, "SLICE_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    x = np.random.default_rng(3).standard_normal((800, 8)).round(3)
    docs = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)],
                                 "vec_id long, embedding array<double>, cell int, block int")
    out = ann.nearest(docs).collect()
    assert len(out) == 40 * 20
    found = {(r.query_id, r.vec_id) for r in out}
    want = {(q, i) for q in range(0, 800, 20) for i in [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:20]}
    assert len(found & want) >= 0.9 * len(want)


def test_rare_language_and_repeated_id(spark):
    rng = np.random.default_rng(5)
    word = lambda parts: "".join(rng.choice(parts, 3))
    text = lambda parts: " ".join(word(parts) for _ in range(25))
    rows = [(7 if k % 2 else k, text(["the", "ing", "and"]), "en") for k in range(3000)]
    rows += [(9000 + k, text(["sch", "ung", "ö"]), "de") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs, max_train=200).collect()
    rare = [r.lang_pred for r in out if r.doc_id >= 9000]
    assert len(out) == len(rows) and rare.count("de") == len(rare)
    assert all(r.lang_pred == "en" for r in out if r.doc_id < 9000)
