"""Exact quantile of a column too large to rank in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.storage import cut_lineage

BINS = 4096
SMALL = 1_000_000


def exact_quantile(df: DataFrame, column: str, q: float, small: int = SMALL) -> float | None:
    """Linear interpolation between the two closest ranks; NULLs are ignored.

    The column is reduced to distinct values with counts (map-side combined, so a value that
    fills the column is no hot key). While many distinct values remain, they are counted in
    ``BINS`` equal bins and only the bin with the wanted rank is kept.
    """
    counts = cut_lineage(
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    rank = q * (total - 1)
    low, high = math.floor(rank), math.ceil(rank)
    below = _value_at(counts, low, small)
    above = below if high == low else _value_at(counts, high, small)
    return below + (above - below) * (rank - low)


def _value_at(counts: DataFrame, rank: int, small: int) -> float:
    """The value with exactly ``rank`` values before it."""
    while True:
        rows, n, lo, hi = counts.agg(
            F.count(F.lit(1)), F.sum("n"), F.min("value"), F.max("value")).first()
        if rows <= small or lo == hi:
            position = rank / (n - 1) if n > 1 else 0.0
            near = counts.agg(F.percentile("value", F.lit(position), F.col("n"))).first()[0]
            return counts.agg(F.min_by("value", F.abs(F.col("value") - near))).first()[0]
        step = (hi - lo) / BINS
        counts = counts.withColumn("bin", F.floor((F.col("value") - F.lit(lo)) / F.lit(step)))
        sizes = {r["bin"]: r["n"] for r in
                 counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
        for wanted in sorted(sizes):
            if rank < sizes[wanted]:
                break
            rank -= sizes[wanted]
        counts = counts.where(F.col("bin") == wanted).drop("bin")
