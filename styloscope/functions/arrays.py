"""Building blocks for whole computations on the arrays of one row (higher-order functions, no shuffle).

A value that is used more than once is bound with ``let``: higher-order functions do not share an argument expression, and
the optimizer may put a projection's expression into the lambda that reads it, once for every element.

Integer pairs are packed in one long, ``high * 2^31 + low`` with ``low < MASK``, so sorting, distinct and intersection
work on arrays of primitive values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 31
MASK = (1 << SHIFT) - 1
#: Up to so many elements, looking each up is cheaper than sorting.
SHORT = 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def lets(values: list[Column], body: Callable[..., Column]) -> Column:
    """``body`` of several values, each evaluated once."""
    def bind(rest: list[Column], bound: tuple) -> Column:
        return body(*bound) if not rest else let(rest[0], lambda v: bind(rest[1:], (*bound, v)))
    return bind(list(values), ())


def upto(n: Column) -> Column:
    """0 .. n - 1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), SHIFT) + low


def high(code: Column) -> Column:
    return F.shiftright(code, SHIFT).cast("int")


def low(code: Column) -> Column:
    return code.bitwiseAND(F.lit(MASK)).cast("int")


def total(numbers: Column, kind: str = "long") -> Column:
    return F.aggregate(numbers, F.lit(0).cast(kind), lambda acc, x: acc + x.cast(kind))


def run_heads(ordered: Column) -> Column:
    """Where each run of equal elements begins in a sorted array."""
    return let(ordered, lambda s: F.filter(upto(F.size(s)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))


def run_lengths(ordered: Column) -> Column:
    """The lengths of the runs of equal elements of a sorted array."""
    return let(ordered, lambda s: let(run_heads(s), lambda h: F.transform(
        h, lambda at, k: F.coalesce(F.get(h, k + 1), F.size(s)) - at)))


def ranked(names: Column) -> Column:
    """struct(nodes, ids): the sorted distinct elements of ``names`` and the place of each element among them.

    Short arrays look each element up; beyond SHORT elements, where that would be quadratic, the elements are sorted with
    their positions and the numbers of the runs are sorted back.
    """
    def looked_up(n: Column) -> Column:
        return let(F.sort_array(F.array_distinct(n)), lambda nodes: F.struct(nodes.alias("nodes"), F.transform(
            n, lambda w: (F.array_position(nodes, w) - 1).cast("int")).alias("ids")))

    def by_sorting(n: Column) -> Column:
        indexed = F.sort_array(F.transform(n, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def ids(s: Column, h: Column) -> Column:
            codes = F.flatten(F.transform(h, lambda at, k: F.transform(
                F.slice(s, at + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - at), lambda x: pack(x["i"], k))))
            return F.transform(F.sort_array(codes), low)

        return let(indexed, lambda s: let(run_heads(F.transform(s, lambda x: x["w"])), lambda h: F.struct(
            F.transform(h, lambda at: F.get(s, at)["w"]).alias("nodes"), ids(s, h).alias("ids"))))

    return let(names, lambda n: F.when(F.size(n) <= SHORT, looked_up(n)).otherwise(by_sorting(n)))


def offsets(codes: Column, n: Column) -> Column:
    """For sorted pairs (k, x): where those of each k = 0 .. n - 1 begin, and their number at the end.

    A mark that sorts just before (k, 0) is put in for each k; the place of mark k is k more than the pairs before it.
    """
    marked = F.sort_array(F.concat(codes, F.transform(upto(n + 1), lambda k: pack(k, F.lit(-1)))))
    return let(marked, lambda m: F.transform(F.filter(upto(F.size(m)), lambda i: low(F.get(m, i)) == MASK),
                                             lambda at, k: at - k))


def differences(starts: Column) -> Column:
    """The sizes between consecutive offsets."""
    return let(starts, lambda s: F.transform(upto(F.size(s) - 1), lambda k: F.get(s, k + 1) - F.get(s, k)))


def matched(a: Column, b: Column) -> Column:
    """For two sorted arrays of distinct elements: the place in ``b`` of each element of ``a``, -1 if it has none.

    Looked up one by one in short arrays, by merging in long ones.
    """
    def side(values: Column, mark: int) -> Column:
        return F.transform(values, lambda w, i: F.struct(w.alias("w"), F.lit(mark).alias("side"), i.alias("i")))

    def merged(x: Column, y: Column) -> Column:
        return let(F.sort_array(F.concat(side(x, 0), side(y, 1))), lambda m: F.transform(
            F.filter(upto(F.size(m)), lambda k: F.get(m, k)["side"] == 0),
            lambda k: F.when(F.get(m, k + 1)["w"] == F.get(m, k)["w"], F.get(m, k + 1)["i"]).otherwise(-1)))

    return lets([a, b], lambda x, y: F.when(F.size(y) <= SHORT, F.transform(
        x, lambda w: (F.array_position(y, w) - 1).cast("int"))).otherwise(merged(x, y)))
