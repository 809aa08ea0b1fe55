"""Round 3: whole training sets, candidates from prefixes found inside rows, steps computed once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from simlattice.functions.shingles import pattern_set
from simlattice.operators import pairs as P


def test_quality_learns_from_every_rated_document(spark):
    from simlattice.llm import quality
    n = 31_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    ratings = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("grade"))
    assert quality.rated_rows(docs, ratings, "doc_id", "text").count() == n


def test_prefixes_deal_no_whole_sets(spark):
    sets = spark.createDataFrame([(i, [f"t{j}" for j in range(100)]) for i in range(5)], "k long, s array<string>")
    counts = spark.sparkContext.broadcast(P._token_counts(P._token_hashes(sets, "k", "s")))
    assert P._prefixes(P._token_hashes(sets, "k", "s"), counts, 0.9).count() == 5 * 11


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_set_candidates_hold_every_similar_pair(spark, t):
    rnd = random.Random(7)
    made = [set(rnd.sample(range(40), rnd.randint(1, 20))) for _ in range(40)]
    made += [s | {99} for s in made[:20]] + [set()]
    sets = {i: s for i, s in enumerate(made)}
    df = spark.createDataFrame([(i, sorted(map(str, s))) for i, s in sets.items()], "k long, s array<string>")
    df = df.unionByName(spark.createDataFrame([(None, ["1", "2"])], df.schema))
    found = {(r.k_l, r.k_r) for r in P.set_candidates(df, "k", "s", t).collect()}
    near = {(a, b) for a, b in itertools.combinations(sets, 2)
            if sets[a] | sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) and sets[a] and sets[b]}
    assert near and near <= found


def test_the_patterns_behind_a_set_stand_once_in_the_plan(spark):
    made = spark.createDataFrame([("if a",)], "code string").select(F.split(F.upper("code"), " ").alias("p"))
    plan = made.select(pattern_set("p").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
