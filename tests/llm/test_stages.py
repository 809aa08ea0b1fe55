"""The stages of the corpus pipeline, alone and in a row, against brute force on repeated and null identifiers."""

import collections
import re
import zlib

import corpus_pipeline
from simlattice.llm import exact_dedup, mixing, ngram_join, quality

BASE = "the quick brown fox jumps over a lazy dog and runs far away from every other animal in these woods today"
OTHER = "some text of its own that nobody else has written down before in this place"
TEXTS = [(10, BASE), (13, BASE + " again"), (13, OTHER), (13, OTHER), (13, OTHER.upper()), (None, BASE + " now"),
         (None, BASE), (None, "rain falls on the hills all day long"), (None, "Rain falls on the hills all day long"),
         (None, None), (None, " "), (5, ""), (5, "one two"), (6, "one  TWO"), (7, "one three"), (7, "one three")]


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Components of rows, links at 3/4 of the union; rows without words are alone."""
    left, out = list(range(len(rows))), []
    sets = [shingles(t) for _, t in rows]
    while left:
        now, todo = [], [left.pop(0)]
        while todo:
            a = todo.pop()
            now.append(a)
            near = [b for b in left if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
            left = [b for b in left if b not in near]
            todo += near
        out.append([rows[i] for i in now])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "ab"[k % 2]) for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, source string")


def test_near_dedup(spark):
    docs = frame(spark, TEXTS)
    out = corpus_pipeline.near_dedup_stage(spark, docs, None)
    assert out.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in out.collect())
    for group in groups(TEXTS):
        mine = sum(kept[r] for r in set(group))
        # rows of equal identifier and text can lie in one group only
        assert mine == (1 if shingles(group[0][1]) else len([r for r in TEXTS if r == group[0]])), group
        ids = [i for i, _ in group if i is not None]
        assert any(kept[r] and r[0] == min(ids, default=None) for r in group), group
    assert ngram_join.drop_near_copies(docs.limit(0)).count() == 0


def test_run(spark, tmp_path):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(20, 60)] + TEXTS[:4] + [(70, BASE), (71, BASE)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = collections.Counter((r.doc_id, r.text_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    source = {}
    for k, r in enumerate(rows):
        source.setdefault(r, "ab"[k % 2])  # one grade: quality keeps all
    by_text = collections.defaultdict(list)
    for r in rows:
        by_text[r[1]].append(r)
    unique = [min(g) for g in by_text.values()]
    kept = [min(g) for g in groups(unique)]
    want = mixing.take_mix(spark.createDataFrame([(i, t, source[i, t]) for i, t in kept],
                                                 "doc_id long, text string, source string"))
    assert out == collections.Counter((r.doc_id, zlib.crc32(r.text.encode())) for r in want.collect())


def test_names_that_clash(spark):
    names = ("__owner", "__ref", "__tail", "__sha_of_row", "__id", "__row", "row", "id", "sha", "ref", "tail", "owner",
             "stays", "nth", "copies", "set_name")
    rows = [(*r, *[f"{k}-{n}" for n in names]) for k, r in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    ratings = spark.createDataFrame([(10, 0), (13, 2), (5, 2), (6, 0), (7, 1)], "doc_id long, grade int")
    for stage in (exact_dedup.drop_copies, ngram_join.drop_near_copies, lambda d: quality.keep_good(d, ratings)):
        out = stage(docs)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(rows) and len(got) == len(set(got))
        assert got and sorted(map(str, got)) == sorted(map(str, [tuple(r) for r in stage(docs).collect()]))
        assert stage(docs.limit(0)).count() == 0
