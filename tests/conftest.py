import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("simlattice-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="simlattice-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def analyze(spark):
    """code snippets -> {id: row with patterns/features/hash}."""
    from simlattice.operators.structure import fingerprint_items

    def run(rows, profiles=None):
        from simlattice.config import DEFAULT_PROFILES
        df = spark.createDataFrame([(i, lang, code) for i, (lang, code) in enumerate(rows)],
                                   "item_id long, language string, code string")
        langs = sorted({lang for lang, _ in rows})
        fp = fingerprint_items(df, profiles or DEFAULT_PROFILES, languages=langs)
        return {r.item_id: r for r in fp.collect()}
    return run


@pytest.fixture(scope="session")
def compare(spark):
    from simlattice.api import compare_code

    def run(code1, lang1, code2, lang2, **kw):
        return compare_code(spark, code1, lang1, code2, lang2, **kw)
    return run
