"""Interactions between the members of a small group.

A group is folded into one array (its size is the number of distinct members, one row each after
the aggregation before) and summed with higher-order functions: no self-join, no row per pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PairValue = Callable[[Column, Column], Column]


def _fold_pairs(start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Fold ``step`` over the unordered pairs of the array column ``members``."""
    members = F.col("members")

    def with_later(acc: Column, at: Column) -> Column:
        one = F.element_at(members, at)
        later = F.slice(members, at + 1, F.size(members))  # empty for the last one
        return F.aggregate(later, acc, lambda total, other: step(total, one, other))

    return F.aggregate(F.sequence(F.lit(1), F.size(members)), start, with_later)


def pair_interactions(df: DataFrame, keys: list[str], member: str, weight: str,
                      sums: dict[str, PairValue], minima: dict[str, PairValue]) -> DataFrame:
    """Per group: weighted sums and minima of pair values; 0 for groups of one."""
    columns = [c for c in df.columns if c not in keys and c != member]
    grouped = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(member, *columns))).alias("members"))
    out = {}
    for name, value in sums.items():
        out[name] = _fold_pairs(
            F.lit(0.0),
            lambda acc, a, b, value=value: acc + value(a, b) * a[weight] * b[weight])
    for name, value in minima.items():
        out[name] = _fold_pairs(
            F.lit(None).cast("double"),
            lambda acc, a, b, value=value: F.least(acc, value(a, b)))
    alone = F.size("members") < 2
    return grouped.withColumns({
        name: F.when(alone, 0.0).otherwise(value) for name, value in out.items()
    }).drop("members")


def gap(column: str) -> PairValue:
    return lambda a, b: F.abs(a[column] - b[column])


def mirrored(column: str) -> PairValue:
    return lambda a, b: F.abs(a[column] + b[column])


def distance(*columns: str) -> PairValue:
    def value(a: Column, b: Column) -> Column:
        return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in columns), F.lit(0.0)))
    return value


def tunnel(angle: str, *columns: str) -> PairValue:
    """Distance at the plate, discounted by the difference of the approach angles."""
    apart = distance(*columns)
    return lambda a, b: apart(a, b) / (1 + gap(angle)(a, b))
