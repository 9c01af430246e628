"""Ordered operators whose groups may be arbitrarily large.

A plain window puts one partition key into one task, so a single hot game (or no key at all) would
stall the job. A carry scan counts the groups first. Groups that fit a task get a plain window.
Otherwise the window runs inside smaller runs of the order: rows with equal leading order columns
or, where those are too many as well, the rows of one range partition. One summary row per run is
then scanned the same way, and its result is carried into the run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks.storage import cut_lineage

TASK_ROWS = 1_000_000


def _directed(columns: list[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]


def _largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; combined map-side, reads the key columns only."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _ranged(df: DataFrame, keys: list[str], order: list[str], part: str, copy: str,
            task_rows: int) -> DataFrame:
    """Rows in order over range partitions of about half ``task_rows``, numbered by ``part``.

    ``copy`` tells rows with equal order columns apart, so copies of one row spread too. Partition
    numbers must not be computed twice, hence the checkpoint.
    """
    parts = 2 * df.count() // task_rows + 1
    numbered = df.withColumn(copy, F.monotonically_increasing_id())
    return cut_lineage(numbered.repartitionByRange(parts, *keys, *order, copy)
                       .withColumn(part, F.spark_partition_id()))


def _join_runs(df: DataFrame, carried: DataFrame, group: list[str], carry: str) -> DataFrame:
    """Bring each run's carry to its rows; NULL keys are runs like any other."""
    renamed = carried.select(*[F.col(c).alias(f"{carry}_{c}") for c in group], carry)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{carry}_{c}")) for c in group))
    return df.join(renamed, same, "left").drop(*[f"{carry}_{c}" for c in group])


def _scan(df: DataFrame, value: str, out: str, order: list[str], keys: list[str], *,
          kind: str, reverse: bool, task_rows: int) -> DataFrame:
    """Add ``out``: the last ``value``, or the sum of them, over the rows before each row."""
    fitting = (n for n in range(len(order)) if _largest_group(df, [*keys, *order[:n]]) <= task_rows)
    depth = next(fitting, None)
    if depth == 0:
        w = W.partitionBy(*keys).orderBy(*_directed(order, reverse))
        return df.withColumn(out, _before(value, w, kind))

    part, copy, carry, first = (f"{out}_{tag}" for tag in ("part", "copy", "carry", "first"))
    if depth is None:
        df = _ranged(df, keys, order, part, copy, task_rows)
        leading, tail = [part], [*order, copy]
    else:
        leading, tail = order[:depth], order[depth:]
    group = [*keys, *leading]

    rank = F.col(tail[0]) if len(tail) == 1 else F.struct(*tail)
    summary = {"last": (F.min_by if reverse else F.max_by)(F.col(value), rank),
               "sum": F.sum(value)}[kind]
    runs = cut_lineage(df.groupBy(*group).agg(summary.alias(value)))
    carried = _scan(runs, value, carry, leading, keys, kind=kind, reverse=reverse,
                    task_rows=task_rows if depth else TASK_ROWS)

    w = W.partitionBy(*group).orderBy(*_directed(tail, reverse))
    inside = df.withColumn(out, _before(value, w, kind))
    if kind == "sum":
        merged = F.col(out) + F.coalesce(F.col(carry), F.lit(0))
    else:
        inside = inside.withColumn(first, F.row_number().over(w) == 1)
        merged = F.when(F.col(first), F.col(carry)).otherwise(F.col(out))
    return _join_runs(inside, carried, group, carry).withColumn(out, merged).drop(
        part, copy, carry, first)


def _before(value: str, w, kind: str) -> Column:
    if kind == "last":
        return F.lag(value).over(w)
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def _scan_by(df, value, out, order_by, partition_by, kind, reverse=False, task_rows=None) -> DataFrame:
    return _scan(df, value, out, list(order_by), list(partition_by), kind=kind, reverse=reverse,
                 task_rows=task_rows or TASK_ROWS)


def previous_value(df: DataFrame, value: str, out: str, order_by: list[str],
                   partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    """``value`` of the row before, within ``partition_by`` or over the whole table."""
    return _scan_by(df, value, out, order_by, partition_by, "last", task_rows=task_rows)


def ordered_delta(df: DataFrame, value: str, out: str, order_by: list[str],
                  partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    """First difference in order; the first row and unknown differences are 0."""
    before = f"{out}_before"
    df = previous_value(df, value, before, order_by, partition_by, task_rows)
    return df.withColumn(out, F.coalesce(F.col(value) - F.col(before), F.lit(0))).drop(before)


def sum_before(df: DataFrame, value: str, out: str, order_by: list[str],
               partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    """Sum of ``value`` over all earlier rows, the row itself left out."""
    return _scan_by(df, value, out, order_by, partition_by, "sum", task_rows=task_rows)


def running_sum(df: DataFrame, value: str, out: str, order_by: list[str],
                partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    df = sum_before(df, value, out, order_by, partition_by, task_rows=task_rows)
    return df.withColumn(out, F.col(out) + F.coalesce(F.col(value), F.lit(0)))


def sum_after(df: DataFrame, value: str, out: str, order_by: list[str],
              partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    """Group total minus running sum, without a join of the total."""
    return _scan_by(df, value, out, order_by, partition_by, "sum", reverse=True, task_rows=task_rows)


def row_position(df: DataFrame, out: str, order_by: list[str],
                 partition_by: list[str] = (), task_rows: int | None = None) -> DataFrame:
    """0-based position of each row in its group or in the whole table."""
    one = f"{out}_one"
    return sum_before(df.withColumn(one, F.lit(1)), one, out, order_by, partition_by,
                      task_rows).drop(one)


def contiguous_folds(df: DataFrame, out: str, order_by: list[str], k: int, n: int) -> DataFrame:
    """Unshuffled folds 0..k-1 of ``n`` >= k rows in order; the first (n mod k) hold one row more."""
    size, extra = divmod(n, k)
    at, in_larger = F.col(f"{out}_at"), extra * (size + 1)
    fold = F.when(at < in_larger, F.floor(at / (size + 1))).otherwise(
        extra + F.floor((at - in_larger) / size))
    return row_position(df, f"{out}_at", order_by).withColumn(out, fold.cast("int")).drop(f"{out}_at")
