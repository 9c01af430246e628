"""Rates, league indices and plus-scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.storage import sized_lookup


def known(*columns: str) -> Column:
    """All columns are non-null; spelled out so Catalyst can turn outer joins into inner ones."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def total(column: Column | str) -> Column:
    """Sum in which a group without values gives 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def rate_metric(df: DataFrame, keys: list[str], *, count: tuple[str, Column],
                hits: tuple[str, Column], rate: str, min_count: int) -> DataFrame:
    """Share of ``hits`` among the counted rows, for groups with at least ``min_count`` of them.

    Only the key columns are grouped on, with a map-side combine, so a busy group is no hot task.
    """
    (n, counted), (h, hit) = count, hits
    grouped = df.where(known(*keys)).groupBy(*keys).agg(
        F.count(counted).alias(n), total(hit).alias(h))
    return (grouped.where(F.col(n) >= min_count)
            .withColumn(rate, F.try_divide(F.col(h).cast("double"), F.col(n).cast("double"))))


def mean_metric(df: DataFrame, keys: list[str], *, value: str, count: str, mean: str,
                min_count: int) -> DataFrame:
    """Mean of ``value`` per group with at least ``min_count`` rows, known value or not."""
    grouped = df.where(known(*keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count), F.avg(value).alias(mean))
    return grouped.where(F.col(count) >= min_count)


def scaled(value: Column, mean: Column, deviation: Column, invert: bool = False) -> Column:
    """100 +/- 10 deviations from the mean; NULL without a positive deviation."""
    z = F.try_divide(value - mean, deviation)
    return F.lit(100) - 10 * z if invert else F.lit(100) + 10 * z


def plus_score(df: DataFrame, scores: dict[str, str], by: list[str] = (),
               invert: frozenset[str] | set[str] = frozenset(), ddof: int = 1) -> DataFrame:
    """Add plus-scores ``{output: value column}``, normalised within ``by`` or over all rows.

    Means and deviations are aggregated with a map-side combine and joined back: a window would
    put a whole season and pitch type into one task. The statistics are one row per ``by`` group;
    how to join them is left to the sizes AQE sees.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    values = list(dict.fromkeys(scores.values()))
    stats = [f(v).alias(f"{v}_{tag}") for v in values for tag, f in (("mean", F.avg), ("sd", spread))]
    if by:
        df = df.join(df.where(known(*by)).groupBy(*by).agg(*stats), list(by), "left")
        stat = F.col
    else:
        row = df.agg(F.struct(*stats).alias("stats")).scalar()
        stat = row.getField
    df = df.withColumns({
        out: scaled(F.col(v), stat(f"{v}_mean"), stat(f"{v}_sd"), out in invert)
        for out, v in scores.items()
    })
    return df.drop(*[f"{v}_{tag}" for v in values for tag in ("mean", "sd")]) if by else df


def z_score(df: DataFrame, scores: dict[str, str], ddof: int = 0) -> DataFrame:
    """Global z-scores ``{output: value column}``, population deviation by default.

    A column without spread has z-score 0.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    row = df.agg(F.struct(*[
        f(v).alias(f"{v}_{tag}")
        for v in dict.fromkeys(scores.values()) for tag, f in (("mean", F.avg), ("sd", spread))
    ]).alias("stats")).scalar()

    def z(v: str) -> Column:
        apart, deviation = F.col(v) - row.getField(f"{v}_mean"), row.getField(f"{v}_sd")
        return F.when(deviation == 0, F.lit(0.0) * F.col(v)).otherwise(apart / deviation)

    return df.withColumns({out: z(v) for out, v in scores.items()})


def weighted_score(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * F.col(c) for c, w in weights.items()))


def weighted_means(df: DataFrame, by: list[str], weight: str, means: dict[str, str]) -> DataFrame:
    """sum(x * w) / sum(w) per group; rows without x still count in the denominator."""
    return df.where(known(*by)).groupBy(*by).agg(*[
        F.try_divide(total(F.col(v) * F.col(weight)), total(weight)).alias(out)
        for out, v in means.items()
    ])


def league_index(league: Column, own: Column) -> Column:
    """100 = league; a value of 0 has no index."""
    return F.try_divide(100 * league, own)


def combine_metrics(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of keyed tables, then only rows known in every column."""
    joined = reduce(lambda a, b: a.join(b, keys, "full_outer"), tables)
    return joined.where(known(*joined.columns))


def join_lookup(facts: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table to a keyed summary, broadcast only if the summary is counted small."""
    return facts.join(sized_lookup(table), on, how)


def keep_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; NULL keys form one group.

    ``min_by`` combines map-side, so a key (or NULL) that fills the table is no hot task.
    """
    others = [c for c in df.columns if c != key]
    kept = df.groupBy(key).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*order)).alias("row"))
    return kept.select(key, *[F.col("row").getField(c).alias(c) for c in others]).select(df.columns)
