"""Control-flow patterns and structural features of source code, as Catalyst folds.

No parser: each file is reduced to structure tokens and folded with
``aggregate`` inside one row (files are bounded, so no shuffle and no Python).

Control-flow pattern ``NAME:d<k>``: ``k`` is the number of enclosing control
statements. Else-if chains stay at the depth of their ``if``; an ``elif`` and a
java ``else if`` always emit the literal ``COND``. A plain ``else`` block is
transparent for python and cpp but adds one level for java.

Structural features ``node_type:d<k>`` use *scope* depth (enclosing blocks),
an approximation of syntax-tree depth: equal lexical structure gives equal
features, but bits can differ from a grammar-based hasher.

Python fold: a stack of control-statement indents over logical lines. A line
pops every entry with indent >= its own; ``for/while/if`` push, ``elif`` pops
its ``if`` and pushes again at the same depth, ``else`` pushes nothing (so the
else block sits at the depth of its ``if``). Lines inside
open brackets or after a backslash are continuations and are skipped.

Brace fold: a string stack of frames I(if) L(loop) D(do) E(plain else)
T(try) ``{`` ``(``. ``(``/``{`` push; ``)``/``}`` drop back past their opener;
``}`` and ``;`` (outside parentheses) complete a statement, which drops the
braceless control frames on top -- except the innermost ``if`` when the next
token is ``else``, and ``try`` when it is ``catch``/``finally``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LanguageProfile
from .text import strip_noise
from .util import chunked_aggregate, let

ND = "struct<n:string,d:int>"
ND_ARRAY = f"array<{ND}>"

PY_BLOCK_KEYWORDS = ("for", "while", "if", "elif", "else", "try", "except", "finally", "with", "def", "class")
PY_LINE_KW = r"^\s*(?:async\s+)?(for|while|if|elif|else|try|except|finally|with|def|class|return)\b"
PY_NOT_CALLS = ("if", "elif", "while", "for", "return", "and", "or", "not", "in", "is",
                "lambda", "yield", "assert", "del", "with", "except", "await", "print_")
BRACE_NOT_CALLS = ("catch", "switch", "sizeof", "synchronized", "typeof", "alignof",
                   "decltype", "static_assert", "return", "new", "delete", "throw")


def _nd(name: Column, depth: Column) -> Column:
    return F.struct(name.cast("string").alias("n"), depth.cast("int").alias("d"))


def _empty_nd() -> Column:
    return F.array().cast(ND_ARRAY)


def _kw_map(profile: LanguageProfile, keywords: dict[str, str]) -> Column | None:
    """Literal map keyword -> pattern for keywords whose node type is mapped."""
    n2p = profile.node_to_pattern()
    pairs = []
    for kw, node in keywords.items():
        if node in n2p:
            pairs += [F.lit(kw), F.lit(n2p[node])]
    return F.create_map(*pairs) if pairs else None


def _lookup(m: Column | None, key: Column) -> Column:
    return F.try_element_at(m, key) if m is not None else F.lit(None).cast("string")


def _node_map(profile: LanguageProfile, keys: dict[str, str]) -> Column | None:
    """Literal map token -> node type, only for structural node types."""
    pairs = []
    for k, node in keys.items():
        if node in profile.structural_nodes:
            pairs += [F.lit(k), F.lit(node)]
    return F.create_map(*pairs) if pairs else None


# ---------------------------------------------------------------------------
# python
# ---------------------------------------------------------------------------
def _python_lines(code: Column, with_calls: bool = True) -> Column:
    cleaned = strip_noise(code, "python")
    lines = F.split(cleaned, "\n")

    def line_info(line: Column) -> Column:
        # literal string functions where a regex is not needed (this runs per line of every file)
        lead = F.regexp_extract(line, r"^[ \t]*", 0)
        ind = F.length(lead) + 7 * (F.length(lead) - F.length(F.translate(lead, "\t", "")))
        has_paren = F.instr(line, "(") > 0
        no_def = F.regexp_replace(line, r"\b(?:def|class)\s+[A-Za-z_]\w*", " ")
        names = F.regexp_extract_all(no_def, F.lit(r"([A-Za-z_]\w*)\s*\("), 1)
        calls = (F.when(has_paren, F.size(F.filter(names, lambda n: ~n.isin(*PY_NOT_CALLS)))).otherwise(F.lit(0))
                 if with_calls else F.lit(0))
        opens = F.length(line) - F.length(F.translate(line, "([{", ""))
        closes = F.length(line) - F.length(F.translate(line, ")]}", ""))
        stripped = F.btrim(line, F.lit(" \t\r\f\u000b"))
        return F.struct(
            ind.cast("int").alias("ind"),
            F.regexp_extract(line, PY_LINE_KW, 1).alias("kw"),
            (opens - closes).cast("int").alias("net"),
            stripped.endswith("\\").alias("bs"),
            (F.length(stripped) == 0).alias("blank"),
            calls.cast("int").alias("calls"))

    return F.transform(lines, line_info)


def python_structure(code: Column, profile: LanguageProfile, with_features: bool = True) -> Column:
    """struct<patterns: array<nd>, features: array<nd>> for python source
    (``with_features=False``: patterns only, features left empty)."""
    kwmap = _kw_map(profile, {"for": "for_statement", "while": "while_statement", "if": "if_statement",
                              "try": "try_statement", "with": "with_statement",
                              "def": "function_definition", "class": "class_definition"})
    nodemap = _node_map(profile, {"for": "for_statement", "while": "while_statement", "if": "if_statement",
                                  "try": "try_statement", "with": "with_statement",
                                  "def": "function_definition", "class": "class_definition",
                                  "return": "return_statement"})
    call_node = "call" if "call" in profile.structural_nodes else None
    if not with_features:
        nodemap, call_node = None, None

    init = F.struct(
        F.array().cast("array<int>").alias("stk"),
        F.array().cast("array<int>").alias("blk"),
        _empty_nd().alias("out"),
        _empty_nd().alias("feats"),
        F.lit(0).alias("bal"),
        F.lit(False).alias("cont"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["blank"], acc).when((acc["bal"] > 0) | acc["cont"], cont_line(acc, x)).otherwise(
            let(F.struct(F.filter(acc["stk"], lambda e: e < x["ind"]).alias("s"),
                         F.filter(acc["blk"], lambda b: b < x["ind"]).alias("b")),
                lambda popped: stmt_line(acc, x, popped["s"], popped["b"])))

    def cont_line(acc: Column, x: Column) -> Column:
        return F.struct(acc["stk"].alias("stk"), acc["blk"].alias("blk"), acc["out"].alias("out"),
                        acc["feats"].alias("feats"),
                        F.greatest(acc["bal"] + x["net"], F.lit(0)).alias("bal"), x["bs"].alias("cont"))

    def stmt_line(acc: Column, x: Column, stk1: Column, blk1: Column) -> Column:
        d = F.size(stk1)                      # every entry is one enclosing control statement
        sd = F.size(blk1)
        kw = x["kw"]
        pat = F.when(kw == "elif", F.lit("COND")).otherwise(_lookup(kwmap, kw))
        ctrl = pat.isNotNull()
        out2 = F.when(ctrl, F.concat(acc["out"], F.array(_nd(pat, d)))).otherwise(acc["out"])
        stk2 = F.when(ctrl, F.concat(stk1, F.array(x["ind"]))).otherwise(stk1)
        blk2 = F.when(kw.isin(*PY_BLOCK_KEYWORDS), F.concat(blk1, F.array(x["ind"]))).otherwise(blk1)
        node = _lookup(nodemap, kw)
        f1 = F.when(node.isNotNull(), F.concat(acc["feats"], F.array(_nd(node, sd)))).otherwise(acc["feats"])
        if call_node:
            f2 = F.concat(f1, F.array_repeat(_nd(F.lit(call_node), sd + 1), x["calls"]))
        else:
            f2 = f1
        return F.struct(stk2.alias("stk"), blk2.alias("blk"), out2.alias("out"), f2.alias("feats"),
                        F.greatest(x["net"], F.lit(0)).alias("bal"), x["bs"].alias("cont"))

    folded = chunked_aggregate(_python_lines(code, with_calls=call_node is not None), init, step,
                               ("stk", "blk", "out", "feats", "bal", "cont"), ("out", "feats"), ND_ARRAY)
    return let(folded, lambda r: F.struct(r["out"].alias("patterns"), r["feats"].alias("features")))


# ---------------------------------------------------------------------------
# java / cpp
# ---------------------------------------------------------------------------
BRACE_FOR_IN = r"\bfor(\s*\([^;{}?]*?[^:?]:[^:])"
BRACE_DECL = (r"\b(?!(?:if|for|while|switch|catch|return|new|else|do|throw|synchronized)\b)"
              r"([A-Za-z_][\w<>\[\],.*&:]*)\s+[*&]*(?!(?:if|for|while|switch|catch|synchronized|return)\b)"
              r"[A-Za-z_]\w*\s*\(([^;{}()]*)\)\s*(?:const\s*)?(?:throws\s+[\w.,\s]+)?\{")
# a word is looked at from its first letter only, and no run is taken back: the same tokens, fewer attempts
BRACE_TOKENS = (r"[{}();]|(?<![A-Za-z_])(?=[A-Za-z_])(?:\belse\s+if\b"
                r"|\b(?:forin|for|while|do|if|else|try|return|class|struct|DECL)\b|[A-Za-z_]\w*+\s*+\()")


def _brace_tokens(code: Column, mark_for_in: bool = True, mark_decl: bool = True) -> Column:
    cleaned = strip_noise(code, "brace")
    marked = F.regexp_replace(cleaned, BRACE_FOR_IN, "forin$1") if mark_for_in else cleaned
    marked = F.regexp_replace(marked, BRACE_DECL, "$1 DECL ($2){") if mark_decl else marked
    toks = F.regexp_extract_all(marked, F.lit(BRACE_TOKENS), 0)
    return let(toks, lambda ts: F.arrays_zip(
        ts.alias("t"), F.concat(F.slice(ts, 2, F.greatest(F.size(ts), F.lit(1))), F.array(F.lit(""))).alias("nx")))


def brace_structure(code: Column, profile: LanguageProfile, with_features: bool = True) -> Column:
    """struct<patterns: array<nd>, features: array<nd>> for java/cpp-like source
    (``with_features=False``: patterns only, features left empty)."""
    n2p = profile.node_to_pattern()
    forin_node = "enhanced_for_statement" if profile.name == "java" else "for_range_loop"
    if "enhanced_for_statement" in n2p and forin_node not in n2p:
        forin_node = "enhanced_for_statement"
    kwnodes = {"for": "for_statement", "forin": forin_node, "while": "while_statement",
               "do": "do_statement", "if": "if_statement", "try": "try_statement"}
    kwmap = _kw_map(profile, kwnodes)
    decl_node = next((n for n in ("method_declaration", "function_definition") if n in profile.structural_nodes), None)
    class_node = next((n for n in ("class_declaration", "class_specifier") if n in profile.structural_nodes), None)
    call_node = next((n for n in ("method_invocation", "call_expression") if n in profile.structural_nodes), None)
    nodemap = _node_map(profile, {"for": "for_statement", "forin": forin_node, "while": "while_statement",
                                  "if": "if_statement", "try": "try_statement", "return": "return_statement"})
    if not with_features:
        decl_node = class_node = call_node = nodemap = None
    # for-in marking only matters when it changes a pattern or a feature
    mark_for_in = with_features or n2p.get(forin_node) != n2p.get("for_statement")
    # a statement whose node type has no pattern encloses nothing that counts: its frame is the small letter
    frame_of = {k: f if kwnodes[k] in n2p else f.lower() for k, f in
                {"for": "L", "forin": "L", "while": "L", "do": "D", "if": "I", "try": "T"}.items()}
    counted = "ILDT" + ("E" if profile.else_counts and "if_statement" in n2p else "")
    elif_pattern = F.lit("COND" if profile.else_counts else n2p["if_statement"]) if "if_statement" in n2p else None

    # stack edits with literal string functions (no regex per token)
    def depth(stk: Column) -> Column:
        return F.length(stk) - F.length(F.translate(stk, counted, ""))

    def drop_back_past(stk: Column, opener: str) -> Column:
        """Remove the last ``opener`` and everything after it (stack unchanged if absent)."""
        p = F.instr(F.reverse(stk), opener)
        return F.when(p > 0, F.substring(stk, 1, F.length(stk) - p)).otherwise(stk)

    def drop_last(stk: Column) -> Column:
        return F.substring(stk, 1, F.length(stk) - 1)

    def scope(stk: Column) -> Column:
        return F.length(F.regexp_replace(F.regexp_replace(stk, r"\(", ""), r"([ILDETildt])\{", "$1"))

    def complete(stk: Column, nx: Column) -> Column:
        # else: drop the innermost if with the loop/else frames above it (I[LE]*$);
        # catch/finally: keep the try, drop what is above it; otherwise drop all braceless frames
        no_le = F.rtrim(stk, F.lit("LEl"))
        else_case = F.when(no_le.endswith("I") | no_le.endswith("i"), drop_last(no_le)).otherwise(stk)
        return (F.when(nx.startswith("else"), else_case)
                 .when(nx.startswith("catch") | nx.startswith("finally"), F.rtrim(stk, F.lit("ILEil")))
                 .otherwise(F.rtrim(stk, F.lit("ILETilt"))))

    init = F.struct(F.lit("").alias("stk"), _empty_nd().alias("out"), _empty_nd().alias("feats"))

    def step(acc: Column, x: Column) -> Column:
        t, nx, stk, out, feats = x["t"], x["nx"], acc["stk"], acc["out"], acc["feats"]

        def st(s, o=None, f=None):
            return F.struct(s.alias("stk"), (o if o is not None else out).alias("out"),
                            (f if f is not None else feats).alias("feats"))

        def add_feat(node: Column | str | None, dep: Column) -> Column:
            if node is None:
                return feats
            nodec = F.lit(node) if isinstance(node, str) else node
            return F.when(nodec.isNotNull(), F.concat(feats, F.array(_nd(nodec, dep)))).otherwise(feats)

        is_call = t.endswith("(") & (t != "(")
        call_name = F.regexp_extract(t, r"^([A-Za-z_]\w*)", 1)
        real_call = is_call & ~call_name.isin(*BRACE_NOT_CALLS)
        kw = F.when(t.startswith("else") & (t != "else"), F.lit("elseif")).otherwise(t)
        pat = _lookup(kwmap, kw)
        frame = F.create_map(*[v for k, fr in frame_of.items() for v in (F.lit(k), F.lit(fr))])
        fr = F.try_element_at(frame, kw)
        node = _lookup(nodemap, kw)
        d = depth(stk)
        sc = scope(stk)
        ctrl_out = F.when(pat.isNotNull(), F.concat(out, F.array(_nd(pat, d)))).otherwise(out)
        elif_out = F.concat(out, F.array(_nd(elif_pattern, d))) if elif_pattern is not None else out
        cases = [
            (t == "(", st(F.concat(stk, F.lit("(")))),
            (t == ")", st(drop_back_past(stk, "("))),
            (t == "{", st(F.concat(stk, F.lit("{")))),
            (t == "}", st(complete(drop_back_past(stk, "{"), nx))),
            (t == ";", st(F.when(stk.endswith("("), stk).otherwise(complete(stk, nx)))),
            (is_call, st(F.concat(stk, F.lit("(")), f=F.when(real_call, add_feat(call_node, sc + 1)).otherwise(feats))),
            (t == "else", st(F.concat(stk, F.lit("E")))),
            (kw == "elseif", st(F.concat(stk, F.lit(frame_of["if"])), o=elif_out,
                                f=add_feat(_lookup(nodemap, F.lit("if")), sc))),
            ((t == "while") & (stk.endswith("D") | stk.endswith("d")), st(drop_last(stk))),
            (fr.isNotNull(), st(F.concat(stk, fr), o=ctrl_out, f=add_feat(node, sc))),
            (t == "return", st(stk, f=add_feat(node, sc))),
            (t.isin("class", "struct"), st(stk, f=add_feat(class_node, sc))),
            (t == "DECL", st(stk, f=add_feat(decl_node, sc)))]
        # one branch inside the other: a long list of branches is walked from its start for each of them
        chosen = acc
        for condition, then in reversed(cases):
            chosen = F.when(condition, then).otherwise(chosen)
        return chosen

    folded = chunked_aggregate(_brace_tokens(code, mark_for_in, mark_decl=decl_node is not None), init, step,
                               ("stk", "out", "feats"), ("out", "feats"), ND_ARRAY)
    return let(folded, lambda r: F.struct(r["out"].alias("patterns"), r["feats"].alias("features")))


def code_structure(code: Column, profile: LanguageProfile, with_features: bool = True) -> Column:
    if profile.lexer == "python":
        return python_structure(code, profile, with_features)
    if profile.lexer == "brace":
        return brace_structure(code, profile, with_features)
    raise ValueError(f"no code fold for lexer {profile.lexer}")


# ---------------------------------------------------------------------------
# normalisation helpers shared by every profile
# ---------------------------------------------------------------------------
def nd_strings(nd_array: Column) -> Column:
    return F.transform(nd_array, lambda x: F.concat(x["n"], F.lit(":d"), x["d"].cast("string")))


def min_depth_shift(nd_array: Column) -> Column:
    """Subtract the item's minimum depth from every depth.

    The array and its minimum are bound once; referencing them from inside the
    per-element lambda would re-evaluate them for every element.
    """
    return let(nd_array, lambda arr: let(
        F.array_min(F.transform(arr, lambda x: x["d"])),
        lambda m: F.transform(arr, lambda x: _nd(x["n"], x["d"] - m))))


def shifted_strings(nd_array: Column, profile: LanguageProfile | None = None) -> Column:
    """``nd_strings(min_depth_shift(map_names(...)))`` in one pass, without the lists in between."""
    n2p = profile.node_to_pattern() if profile is not None else {}
    m = F.create_map(*[v for k, p in n2p.items() for v in (F.lit(k), F.lit(p))]) if n2p else None

    def name(n: Column) -> Column:
        return n if m is None else F.coalesce(F.try_element_at(m, n), n)

    return let(nd_array, lambda arr: let(
        F.array_min(F.transform(arr, lambda x: x["d"])),
        lambda least: F.transform(arr, lambda x: F.concat(name(x["n"]), F.lit(":d"), (x["d"] - least).cast("string")))))


def map_names(nd_array: Column, profile: LanguageProfile) -> Column:
    """Replace node names by their universal pattern where mapped."""
    n2p = profile.node_to_pattern()
    if not n2p:
        return nd_array
    m = F.create_map(*[v for k, p in n2p.items() for v in (F.lit(k), F.lit(p))])
    return F.transform(nd_array, lambda x: _nd(F.coalesce(F.try_element_at(m, x["n"]), x["n"]), x["d"]))
