"""Array expressions over one long text: names for values, running totals, pieces by position.

Catalyst may copy an expression to every place that mentions it, inside a lambda
too, where it is evaluated anew for each element. A lambda's variable holds a
value instead, so :func:`let` evaluates it once a row. Running totals are sums over
blocks, so that n elements take n times a block's length and not n squared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128  # elements of a block of running totals
CHUNK = 2048  # characters of a chunk of a text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(array: Column) -> Column:
    """0, 1, ... for every element; none for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``merge`` over all before it; ``zero`` for the first."""
    fold = lambda part: F.aggregate(part, zero, merge)
    block_of = lambda i: F.floor(i / BLOCK).cast("int")

    def placed(v: Column, starts: Column) -> Column:
        inside = lambda i: fold(F.slice(v, block_of(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK))))
        return F.transform(indices(v), lambda i: merge(F.get(starts, block_of(i)), inside(i)))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block_of(F.size(v))), lambda b: fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))

    def starts(sums: Column) -> Column:
        return F.transform(indices(sums), lambda b: fold(F.slice(sums, F.lit(1), b)))

    return let(values, lambda v: let(blocks(v), lambda sums: let(starts(sums), lambda s: placed(v, s))))


def running_sum(values: Column) -> Column:
    return running(values, F.lit(0), lambda s, x: s + x)


def chunks(text: Column) -> Column:
    """``text`` in pieces of ``CHUNK`` characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` (exclusive) of a text in ``chunks``, without a walk from its beginning."""
    first = F.floor(start / CHUNK).cast("int")
    last = F.floor(end / CHUNK).cast("int")
    joined = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.substring(joined, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))
