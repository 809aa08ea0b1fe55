"""Folds in Arrow batches give what the Catalyst folds give, which take the code that is not plain ASCII."""

import random

import pytest

from simlattice.config import DEFAULT_PROFILES, DetectorConfig, update_patterns
from simlattice.operators import structure as S

PY = ["for x in a:", "while x:", "if a:", "elif b:", "else:", "try:", "with o() as f:", "def f(a):", "class C(B):",
      "return f(x)", "\t", "  ", "    ", "\n", "\n", "\r", "# if\n", "'for'", "\"if\\\"x\"", "'''\nfor y in z:\n'''",
      "x = (1,", "foo(bar(2))", ")", "[", "]", "\\\n", "async for q in r:", "'a\\\rb'", "not (a)"]
BRACE = ["for (int i = 0; i < n; ++i)", "for (int v : xs)", "while (a)", "do", "if (a)", "else", "else if (b)", "{", "}",
         "{", "}", ";", "(", ")", "try", "catch (E e)", "finally", "return f(x);", "class A", "void f(int a) {",
         "int h() throws E, F {", "// if\n", "/* for { */", "#define if (x)\n", " #a\r", "\n", " ", "\"} else (\"", "'{'",
         "elsewhere(", "foo (", "a ? b : c", "1if (", "0x1f(", "12 (", "1else if", "else + if (a)", "while(z);", "DECL (",
         "_else if", "'a\\\rb'"]
OTHER = [(None, None), ("python", None), ("java", " \n"), ("cpp", "if (ä) { x(); }"), ("python", "if é:\n  for x in y: z"),
         ("html", "<ul><li>a</li></ul>"), ("text", "a b")]


@pytest.fixture(scope="module")
def code(spark):
    rnd, rows = random.Random(3), list(OTHER)
    for _ in range(60):
        for lang, parts in (("python", PY), ("java", BRACE), ("cpp", BRACE)):
            rows.append((lang, "".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(1, 60)))))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "item_id long, language string, code string").coalesce(1)


CUSTOM = update_patterns(update_patterns(DEFAULT_PROFILES, "java", {"COND": [], "TRY": ["try_statement"]}),
                         "cpp", {"LOOP": ["for_statement"], "Ä": ["if_statement", "return_statement"]})


def test_equal_to_the_catalyst_folds(code, monkeypatch):
    odd = DetectorConfig(hash_bits=136, shingle_sizes=(1, 2, 6), shingle_thresholds=(3, 9))
    runs = [lambda: S.fingerprint_items(code), lambda: S.structure(code, CUSTOM, with_features=False),
            lambda: S.fingerprint_items(code, CUSTOM, cfg=odd, with_lists=False)]
    new = [run() for run in runs]
    monkeypatch.setattr(S, "_plain_code", lambda *args, **kw: None)
    for a, run in zip(new, runs):
        b = run()
        assert a.dtypes == b.dtypes
        assert sorted(a.collect(), key=lambda r: r.item_id) == sorted(b.collect(), key=lambda r: r.item_id)


def test_code_is_folded_once_in_batches(code):
    plan = S.fingerprint_items(code)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "ArrowEvalPython" not in S.fingerprint_items(code, languages=["html", "text"])._jdf.queryExecution().executedPlan().toString()
