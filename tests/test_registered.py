"""Every registered query of the library, called as the driver calls it, against its DuckDB SQL on the smallest tables."""

import os

import pytest

from simlattice.plans import registry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_registered(spark, views, key):
    got, want = registry.queries()[key](spark, SF), views.sql(registry.oracle_sql()[key])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
    spark.catalog.clearCache()
