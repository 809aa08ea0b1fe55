"""Expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(expr: Column, fn) -> Column:
    """Bind ``expr`` once and build a value from it.

    A fold over no elements evaluates ``expr``, its start, a single time even
    when ``fn``, its finish, uses it many times or the optimizer inlines the
    result into several consumers (conditional branches are not shared by
    subexpression elimination, so this is the engine's explicit
    common-subexpression tool). ``transform`` would copy the value, with all
    its strings and arrays, each time.
    """
    return F.aggregate(F.array().cast("array<int>"), expr, lambda bound, _: bound, fn)


#: Tokens of a fold's inner level.
FOLD_CHUNK = 128


def chunked_aggregate(tokens: Column, init: Column, step, fields: tuple[str, ...], emitted: tuple[str, ...],
                      element: str) -> Column:
    """``aggregate(tokens, init, step)`` for steps that append to the ``emitted`` arrays, in time linear in the tokens.

    An append copies the array. So the inner fold appends to arrays of one chunk, and the outer fold carries the
    other ``fields`` of the accumulator and one array per chunk; they are flattened at the end.
    """
    empty, nested = F.array().cast(element), F.array().cast(f"array<{element}>")

    def acc_of(of, of_emitted) -> Column:
        return F.struct(*[(of_emitted(f) if f in emitted else of(f)).alias(f) for f in fields])

    def over(bound: Column) -> Column:
        def outer(acc: Column, i: Column) -> Column:
            start = acc_of(lambda f: acc[f], lambda f: empty)
            inner = F.aggregate(F.slice(bound, i * FOLD_CHUNK + 1, FOLD_CHUNK), start, step)
            return let(inner, lambda r: acc_of(lambda f: r[f], lambda f: F.concat(acc[f], F.array(r[f]))))

        first = let(init, lambda r: acc_of(lambda f: r[f], lambda f: nested))
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bound) / FOLD_CHUNK).cast("int") - 1, F.lit(0)))
        return let(F.aggregate(chunks, first, outer), lambda r: acc_of(lambda f: r[f], lambda f: F.flatten(r[f])))

    return let(tokens, over)
