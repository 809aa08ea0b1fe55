"""Text helpers: noise stripping, blank test, previews, path parts, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Literals use possessive loops: Java would match a plain group loop by recursion and overflow its stack on a long one.
# Strings are matched first so a quote inside a comment or '#' in a string is
# handled by whichever starts first (leftmost match).
PY_NOISE = (r'"""[\s\S]*?"""' r"|'''[\s\S]*?'''"
            r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'" r"|#[^\n]*+")
BRACE_NOISE = (r'"""[\s\S]*?"""' r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
               r"|//[^\n]*" r"|/\*[\s\S]*?\*/" r"|(?m)^[ \t]*#[^\n]*")
HTML_NOISE = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"


def strip_noise(code, lexer: str) -> Column:
    """Blank out literals and comments so only structure tokens remain."""
    c = _col(code)
    if lexer == "python":
        return F.regexp_replace(c, PY_NOISE, "")
    if lexer == "brace":
        # the (?m) flag must lead the pattern for Java; it is harmless for the rest
        return F.regexp_replace(c, "(?m)" + BRACE_NOISE.replace("(?m)", ""), " ")
    if lexer == "html":
        return F.regexp_replace(c, HTML_NOISE, "")
    return c


def is_blank(code) -> Column:
    """True when the text has no non-whitespace character (Unicode aware)."""
    return ~F.regexp_like(F.coalesce(_col(code), F.lit("")), F.lit(r"(?U)\S"))


def preview(code, n: int) -> Column:
    c = _col(code)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def extension(path) -> Column:
    """Lower-cased last suffix of the final path component ('' if none)."""
    p = _col(path)
    name = F.regexp_extract(p, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def patterns_text(patterns) -> Column:
    """Storage codec: patterns joined by '|' ('' when empty or null)."""
    return F.coalesce(F.array_join(_col(patterns), "|"), F.lit(""))


def patterns_from_text(text) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\|"))
