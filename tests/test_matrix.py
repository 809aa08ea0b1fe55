"""The item x item matrix."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simlattice.operators.compare import compare_pairs
from simlattice.operators.pairs import item_matrix
from simlattice.operators.structure import fingerprint_items


def _fp(spark, n=25):
    items = spark.createDataFrame([(i, "text", " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(n)],
                                  "item_id long, language string, code string")
    return fingerprint_items(items, languages=["text"]).withColumn("name", F.concat(F.lit("n"), "item_id"))


def test_matrix_is_dense_and_symmetric(spark):
    fp = _fp(spark)
    chosen = spark.createDataFrame([(1,), (4,), (4,), (9,), (None,), (999,)], "item_id long")
    cells = {(r.item_a, r.item_b): r for r in item_matrix(fp, chosen).collect()}
    assert sorted(cells) == [(a, b) for a in (1, 4, 9) for b in (1, 4, 9)]
    pairs = spark.createDataFrame([(1, 4), (1, 9), (4, 9)], "item_a long, item_b long")
    want = {(r.item_a, r.item_b): r.similarity for r in compare_pairs(pairs, fp).collect()}
    for (a, b), r in cells.items():
        assert r.similarity == (1.0 if a == b else want[min(a, b), max(a, b)])
        assert (r.name_a, r.name_b) == (f"n{a}", f"n{b}")


def test_matrix_bounds(spark):
    fp = _fp(spark)
    assert item_matrix(fp, spark.createDataFrame([], "item_id long")).count() == 0
    assert item_matrix(fp, fp.select("item_id").filter("item_id < 20")).count() == 400
    with pytest.raises(PySparkException, match="20 items at most"):
        item_matrix(fp, fp.select("item_id").filter("item_id < 21")).collect()
