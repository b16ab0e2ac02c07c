"""Array expressions whose work grows with the arrays' sizes, not with their product."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often `use` names it.

    No step is taken: the value is where an aggregate starts, and `use` finishes it.  (A
    transform would copy what `use` gives, with all its texts, at each level of nesting.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, use)


def counts_before(points: Column, marks: Column, touching: bool = False) -> Column:
    """For each mark how many points lie before it, or at it where `touching`; marks and points are arrays of integers in any order.

    Both are sorted together: before the j-th mark at place i stand i - j points.
    """
    point, mark = (0, 1) if touching else (1, 0)
    one = lambda at, kind, k: F.struct(at.alias("at"), F.lit(kind).alias("kind"), k.alias("k"))
    both = F.concat(F.transform(points, lambda p: one(p, point, F.lit(-1))), F.transform(marks, lambda m, k: one(m, mark, k)))
    placed = F.filter(F.transform(F.sort_array(both), lambda e, i: F.struct(e["k"].alias("k"), i.alias("i"))), lambda e: e["k"] >= 0)
    aligned = F.sort_array(F.transform(placed, lambda e, j: F.struct(e["k"].alias("k"), (e["i"] - j).alias("n"))))
    return F.transform(aligned, lambda e: e["n"])


def sums_before(sizes: Column, run: int, levels: int = 2) -> Column:
    """For each of the integers the sum of those before it; one more sum may follow.

    Sums run within `run` integers and over the runs, which may be as many as
    `run` to the power of `levels` before an array grows one by one to more than that.
    """
    grown = lambda own, begin: F.aggregate(own, F.array(begin), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    if not levels:
        return grown(sizes, F.lit(0))

    def long(own):
        runs = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / run).cast("int"))
        totals = F.transform(runs, lambda j: F.aggregate(F.slice(own, j * run + 1, F.lit(run)), F.lit(0), lambda a, n: a + n))
        return bound(sums_before(totals, run, levels - 1), lambda begins: F.flatten(F.transform(runs, lambda j: grown(F.slice(own, j * run + 1, F.lit(run - 1)), begins[j]))))

    return bound(sizes, lambda own: F.when(F.size(own) <= run, grown(own, F.lit(0))).otherwise(long(own)))
