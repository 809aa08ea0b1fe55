"""What cannot meet is not dealt, and shuffle files of finished steps go."""

import glob
import time

from pyspark.sql import functions as F

from simlattice.operators import pairs as P
from simlattice.session import FREE_SHUFFLES, kept_table


def test_prefixes_hold_only_tokens_of_the_other_side(spark, monkeypatch):
    made, plain = [], P._prefixes

    def spy(*args):
        made.append(plain(*args))
        return made[-1]
    monkeypatch.setattr(P, "_prefixes", spy)
    left = spark.createDataFrame([(1, ["a", "b"])], "k long, s array<string>")
    right = spark.createDataFrame([(i, ["a", "b"] if i == 7 else [f"x{i}_{j}" for j in range(50)]) for i in range(20)], left.schema)
    found = P.set_candidates(left, "k", "s", 0.5, right=right)
    assert [(r.k_l, r.k_r) for r in found.collect()] == [(1, 7)]
    assert made[1].filter("k != 7").count() < 10 and made[1].filter("k = 7").count() == 2


def test_neighbours_that_meet_nothing_are_not_dealt(spark):
    one = "0123456789abcdef" * 4
    rows = spark.createDataFrame([(1, one), (2, "1" + one[1:]), (3, "f" * 64)], "k long, h string")
    d = 25
    exact = P.band_rows(rows, "k", "h", d).select("k", F.xxhash64("band", "val").alias("cell"))
    near = P.band_rows(rows, "k", "h", d, neighbours=True).select("k", F.xxhash64("band", "val").alias("cell"))
    held = spark.sparkContext.broadcast(P._cell_sketch(exact))
    kept = near.mapInArrow(P._held_cells(held), "k long, cell long")
    assert 39 <= kept.count() < 80 < near.count()
    assert kept.join(exact.select("cell").distinct(), "cell").count() == near.join(exact.select("cell").distinct(), "cell").count()
    assert [(r.k_l, r.k_r) for r in P.hash_candidates(rows, "k", "h", d).collect()] == [(1, 2)]


def test_a_kept_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = spark.conf.get(FREE_SHUFFLES, None)

    def files():
        return {x for d in manager.localDirs() for x in glob.glob(f"{d.getPath()}/*/shuffle_*")}
    held = files()
    kept = kept_table(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("g")).count(), "freed")
    until = time.time() + 20
    while files() - held and time.time() < until:
        time.sleep(0.2)
    assert not files() - held
    assert kept.count() == 7 and spark.conf.get(FREE_SHUFFLES, None) == before
