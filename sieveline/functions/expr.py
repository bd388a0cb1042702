"""Evaluating a sub-expression once, and running totals inside an array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda evaluates whatever it captures for every element. Bound like this, a captured expression is a variable that
    already has its value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# ``aggregate`` copies its whole accumulator at every step, so collecting results in it costs n^2. Running values are
# therefore taken over blocks of this many elements with a plain number as accumulator.
BLOCK = 32


def pick(xs: Column, first: Column, last: Column) -> Column:
    """Elements ``first`` to ``last`` (1-based, at least one). ``slice`` would walk the whole array for each call."""
    return F.transform(F.sequence(first, last), lambda j: F.element_at(xs, j))


def prefixes(items: Column, zero: Column, value: Callable[[Column], Column],
             combine: Callable[[Column, Column], Column]) -> Column:
    """For each element the combined ``value`` of all elements before it, e.g. running sums or running maxima."""

    def fold(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda acc, x: combine(acc, value(x)))

    def fold_values(xs: Column) -> Column:
        return F.aggregate(xs, zero, combine)

    def within(block: Column, before: Column, total: Callable[[Column], Column]) -> Column:
        return F.transform(block, lambda _, i: combine(before, total(F.slice(block, F.lit(1), i))))

    def cut(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: pick(xs, at, F.least(at + (BLOCK - 1), n)))

    def few(totals: Column) -> Column:
        return F.transform(totals, lambda _, k: fold_values(F.slice(totals, F.lit(1), k)))

    def many(totals: Column) -> Column:
        """The same by blocks of totals: their sums are so few that folding them again costs little."""
        return let(cut(totals), lambda groups: let(F.transform(groups, fold_values), lambda sums: F.flatten(F.zip_with(
            groups, few(sums), lambda group, before: within(group, before, fold_values)))))

    def blocked(xs: Column) -> Column:
        return let(cut(xs), lambda blocks: let(F.transform(blocks, fold), lambda totals: F.flatten(F.zip_with(
            blocks, F.when(F.size(totals) <= 2 * BLOCK, few(totals)).otherwise(many(totals)), lambda block, before: within(block, before, fold)))))

    return let(items, blocked)


def unnest(df: DataFrame, keys: Sequence[str | Column], rows: Column, marker: str) -> DataFrame:
    """``keys`` with the elements of an array of structs, one per row; ``marker`` is a field that is never null.

    A plain ``inline`` makes the optimizer add a non-empty test on the array, and pushing that test down computes the
    array twice. The outer form has no such test; its padding row is dropped afterwards.
    """
    return df.select(*keys, F.inline_outer(rows)).where(F.col(marker).isNotNull())


def unnest_map(df: DataFrame, keys: Sequence[str | Column], entries: Column, key: str, value: str) -> DataFrame:
    """``keys`` with the entries of a map, one per row; see ``unnest``."""
    return df.select(*keys, F.explode_outer(entries).alias(key, value)).where(F.col(key).isNotNull())
