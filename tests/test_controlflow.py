"""Control-flow patterns from source text (python indentation fold, brace fold)."""

from snippets import (KINDS_CPP, KINDS_JAVA, KINDS_PY, GRID_CPP, GRID_JAVA, GRID_PY)


def pats(analyze, lang, code):
    return list(analyze([(lang, code)])[0].patterns)


def test_bubble_sort_three_languages(analyze):
    out = analyze([("python", GRID_PY), ("java", GRID_JAVA), ("cpp", GRID_CPP)])
    for r in out.values():
        assert list(r.patterns) == ["LOOP:d0", "LOOP:d1", "COND:d2"]


def test_binary_search_else_if_chain(analyze):
    out = analyze([("python", KINDS_PY), ("java", KINDS_JAVA), ("cpp", KINDS_CPP)])
    for r in out.values():
        assert list(r.patterns) == ["LOOP:d0", "COND:d1", "COND:d1"]


def test_empty_whitespace_and_plain_statement(analyze):
    out = analyze([("python", ""), ("python", "   \n\t\n"), ("python", "x = 1\n"), ("java", "int x = 1;")])
    for r in out.values():
        assert list(r.patterns) == []


def test_comments_and_blank_lines_do_not_matter(analyze):
    code = "# for i in range(3):\n\n\nif a:  # while True:\n    s = 'for x in y'\n\n    t = \"\"\"\nwhile 1:\n\"\"\"\n"
    assert pats(analyze, "python", code) == ["COND:d0"]
    j = "/* for (;;) { */ // while (x) {\nif (a) { s = \"} else if (\"; c = '{'; }"
    assert pats(analyze, "java", j) == ["COND:d0"]


def test_for_and_while_are_both_loops(analyze):
    a = pats(analyze, "python", "for i in x:\n    pass\n")
    b = pats(analyze, "python", "while i < 3:\n    i += 1\n")
    assert a == b == ["LOOP:d0"]


def test_triple_nest_with_condition(analyze):
    py = "for a in x:\n  for b in y:\n    for c in z:\n      if a:\n        pass\n"
    cpp = "for(;;){ for(;;) { for (;;) { if (a) { x(); } } } }"
    assert pats(analyze, "python", py) == pats(analyze, "cpp", cpp) == ["LOOP:d0", "LOOP:d1", "LOOP:d2", "COND:d3"]


def test_sequential_ifs(analyze):
    py = "if a:\n  x\nif b:\n  y\nif c:\n  z\n"
    java = "if (a) { x(); } if (b) { y(); } if (c) { z(); }"
    assert pats(analyze, "python", py) == pats(analyze, "java", java) == ["COND:d0"] * 3


def test_plain_else_rule_per_language(analyze):
    # a condition inside a plain else block: transparent for python/cpp, one level for java
    py = "if a:\n    x = 1\nelse:\n    if b:\n        y = 2\n"
    java = "if (a) { x = 1; } else { if (b) { y = 2; } }"
    cpp = "if (a) { x = 1; } else { if (b) { y = 2; } }"
    assert pats(analyze, "python", py) == ["COND:d0", "COND:d0"]
    assert pats(analyze, "cpp", cpp) == ["COND:d0", "COND:d0"]
    assert pats(analyze, "java", java) == ["COND:d0", "COND:d1"]


def test_braceless_and_dangling_else(analyze):
    java = "if (a) if (b) x(); else y(); for (;;) z();"
    assert pats(analyze, "java", java) == ["COND:d0", "COND:d1", "LOOP:d0"]
    cpp = "if (a) x(); else if (b) y(); else z();\nwhile (k) k--;"
    assert pats(analyze, "cpp", cpp) == ["COND:d0", "COND:d0", "LOOP:d0"]


def test_do_while_is_one_loop(analyze):
    java = "do { if (x) y(); } while (z); while (q) { r(); }"
    assert pats(analyze, "java", java) == ["LOOP:d0", "COND:d1", "LOOP:d0"]


def test_enhanced_for_and_lambda_argument(analyze):
    java = "for (int v : xs) { list.forEach(e -> { if (e > v) out(e); }); }"
    assert pats(analyze, "java", java) == ["LOOP:d0", "COND:d1"]


def test_python_continuation_lines_are_skipped(analyze):
    code = "rows = [x\n        for x in data\n        if x]\nif rows:\n    total = (1 +\n        2)\n"
    assert pats(analyze, "python", code) == ["COND:d0"]


def test_elif_stays_at_if_depth(analyze):
    code = "for i in x:\n    if a:\n        pass\n    elif b:\n        pass\n    elif c:\n        pass\n"
    assert pats(analyze, "python", code) == ["LOOP:d0", "COND:d1", "COND:d1", "COND:d1"]


def test_structural_features_use_scope_depth(analyze):
    r = analyze([("python", "def f(x):\n    for i in x:\n        g(i)\n    return 1\n")])[0]
    assert list(r.features) == ["function_definition:d0", "for_statement:d1", "call:d3", "return_statement:d1"]
    assert list(r.normalized) == ["function_definition:d0", "LOOP:d1", "call:d3", "return_statement:d1"]
