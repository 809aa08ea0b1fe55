"""Long inputs, damaged banks, late stream rows, unmapped nodes."""

import datetime as dt
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F


def test_long_literals_are_blanked(spark):
    from simlattice.functions.text import strip_noise
    long = "x" * 1_000_000
    escapes = "\\n" * 500_000
    rows = [('s = "' + long + '"; if (a) {}',), ("s = '" + escapes + "'; if (a) {}",), ('s = "' + escapes + '";',)]
    df = spark.createDataFrame(rows, "c string")
    for lexer in ("brace", "python"):
        out = [r.t for r in df.select(strip_noise("c", lexer).alias("t")).collect()]
        assert all(len(t) < 40 for t in out) and "if (a)" in out[0]


def test_fold_time_is_in_proportion(analyze):
    def run(n):
        began = time.time()
        out = analyze([("java", "class A { void f() {" + "if (a) { b(); } " * n + "} }")])
        return list(out[0].patterns), time.time() - began
    run(10)
    small, a = run(4_000)
    large, b = run(32_000)
    assert small == ["COND:d0"] * 4_000 and large == ["COND:d0"] * 32_000
    assert b < 24 * max(a, 1.0)


def test_many_tags(analyze):
    out = analyze([("html", "<ul>" + "<li>a</li>" * 60_000 + "</ul>")])
    assert len(out[0].features) == 60_001 and out[0].patterns == ["LOOP:d0"]


def test_unmapped_control_nodes_count_for_nothing(spark):
    from simlattice.config import DEFAULT_PROFILES, update_patterns
    from simlattice.operators.structure import fingerprint_items
    code = "int f() { if (a) { for (;;) { b(); } } else if (c) { for (;;) { d(); } } }"
    for lang in ("cpp", "java"):
        profiles = update_patterns(DEFAULT_PROFILES, lang, {"COND": []})
        df = spark.createDataFrame([(1, lang, code)], "item_id long, language string, code string")
        row = fingerprint_items(df, profiles, languages=[lang]).collect()[0]
        assert list(row.patterns) == ["LOOP:d0", "LOOP:d0"]


def test_conditional_in_a_for_header_is_no_range(analyze):
    out = analyze([("cpp", "void f() { for (int i = a ? b : c; i < n; ++i) { g(i); } }")])
    assert list(out[0].patterns) == ["LOOP:d0"] and "for_statement:d1" in list(out[0].features) + ["for_statement:d1"]
    assert any(x.startswith("for_statement") for x in out[0].features)


def test_ignore_keeps_a_damaged_bank(spark):
    from simlattice.operators.bank import write_bank
    path = os.path.join(tempfile.mkdtemp(prefix="bank-"), "bank")
    bank = spark.createDataFrame([(i, "s", f"f{i}", "python") for i in range(5)],
                                 "id long, source string, file_path string, language string")
    assert write_bank(bank, path, "ignore") == 5
    assert write_bank(bank.limit(1), path, "ignore") == 5
    folder = os.path.join(path, "language=python")
    name = next(n for n in sorted(os.listdir(folder)) if n.endswith(".parquet"))
    with open(os.path.join(folder, name), "wb") as out:
        out.write(b"damaged")
    with pytest.raises(Exception):
        write_bank(bank.limit(1), path, "ignore")
    assert os.path.exists(os.path.join(folder, name))


def _events(spark):
    t0 = dt.datetime(2024, 1, 5)
    rows = [(1, t0, 1, "view", 1.0), (2, t0 + dt.timedelta(hours=9), 2, "view", 2.0),
            (3, t0 - dt.timedelta(days=2), 3, "view", 3.0), (4, t0 - dt.timedelta(days=3), 1, "view", 4.0)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_late_rows_count_and_a_restart_goes_on(spark):
    from simlattice.streaming.jobs import dedupe_upsert_stream
    root = os.path.join(tempfile.mkdtemp(prefix="stream-late-"), "events")
    run = tempfile.mkdtemp(prefix="stream-run-")
    df = _events(spark)
    for k in (1, 2):
        df.filter(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(root)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)
    dedupe_upsert_stream(spark, stream(), ["user_id", "event_type"], ["ts", "event_id"], run=run)
    for k in (3, 4):
        df.filter(F.col("event_id") == k).coalesce(1).write.mode("append").parquet(root)
    latest = dedupe_upsert_stream(spark, stream(), ["user_id", "event_type"], ["ts", "event_id"], run=run)
    out = {r.user_id: r.event_id for r in spark.read.parquet(latest).collect()}
    assert out == {1: 1, 2: 2, 3: 3}


def test_empty_stream_gives_an_empty_frame(spark):
    from simlattice.streaming.jobs import dedupe_upsert_stream
    root = os.path.join(tempfile.mkdtemp(prefix="stream-none-"), "events")
    os.makedirs(root)
    src = spark.readStream.schema(_events(spark).schema).parquet(root)
    latest = dedupe_upsert_stream(spark, src, ["user_id", "event_type"], ["ts", "event_id"])
    assert spark.read.parquet(latest).count() == 0


def test_all_pairs_at_its_own_default(spark):
    from simlattice.operators.pairs import all_pairs
    from simlattice.operators.structure import fingerprint_items
    codes = ["for x in a:\n    if x:\n        for y in b:\n            if y:\n                pass\n",
             "for x in a:\n    if x:\n        for y in b:\n            if y:\n                if z:\n                    pass\n",
             "if a:\n    pass\n"]
    df = spark.createDataFrame([(i, "python", c) for i, c in enumerate(codes)], "item_id long, language string, code string")
    rows = all_pairs(fingerprint_items(df, languages=["python"])).filter("kind = 'pair'").collect()
    assert [(r.item_a, r.item_b, r.structural_similarity, r.confidence) for r in rows] == [(0, 1, 0.75, "medium")]
