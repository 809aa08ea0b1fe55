"""Node streams: html tag depth and skew-safe sequence positions."""

import datetime as dt

from pyspark.sql import functions as F


def test_html_stream_matches_in_row_fold(spark):
    from simlattice.operators.nodes import html_node_stream
    from simlattice.operators.structure import structure
    html = ("<html><head><script>var s='</p>';</script><style>p{}</style></head><body><nav><ul><li>a</li>"
            "<li>b<br></li></ul></nav><!-- <div> --><div><p>x<p>y</div></body></html>")
    items = spark.createDataFrame([(1, "html", html)], "item_id long, language string, code string")
    ns = html_node_stream(items).orderBy("pos").collect()
    assert [(r.node_type, r.depth) for r in ns][:6] == [("html", 0), ("head", 1), ("body", 1), ("nav", 2),
                                                       ("ul", 3), ("li", 4)]
    s = structure(items, languages=["html"]).collect()[0]
    structural = [f"{r.node_type}:d{r.depth}" for r in ns if r.node_type not in ("br", "a", "b")]
    assert list(s.features) == structural
    assert list(s.patterns) == ["COND:d0", "LOOP:d1", "COND:d0", "COND:d1"]


def test_sequence_positions_dense_across_buckets(spark):
    from simlattice.operators.nodes import sequence_node_stream
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=37 * i), 1 if i % 3 else 2, f"e{i % 4}") for i in range(60)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    out = sequence_node_stream(ev, bucket_seconds=600).collect()
    by_user = {}
    for r in out:
        by_user.setdefault(r.item_id, []).append(r)
    for user, rs in by_user.items():
        rs.sort(key=lambda r: r.pos)
        assert [r.pos for r in rs] == list(range(len(rs)))
        assert [r.ts for r in rs] == sorted(r.ts for r in rs)


def test_sequence_shingles(spark):
    from simlattice.operators.nodes import sequence_node_stream
    from simlattice.plans.sequences import sequence_shingles
    base = dt.datetime(2024, 1, 1)
    rows = [(1, base, 1, "a"), (2, base + dt.timedelta(hours=5), 1, "b"), (3, base + dt.timedelta(days=3), 1, "c"),
            (4, base + dt.timedelta(days=4), 1, "d"), (5, base, 2, "x"), (6, base + dt.timedelta(seconds=1), 2, "y")]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    sh = sorted((r.item_id, r.pos, r.shingle) for r in sequence_shingles(sequence_node_stream(ev), 3).collect())
    assert sh == [(1, 0, "a b c"), (1, 1, "b c d"), (2, 0, "x y")]
