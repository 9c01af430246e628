"""Sums and minima over all pairs of a group of any size, without forming the pairs.

The weighted sum of ``|x_i - x_j|`` needs only the values in order: each row adds its weight times its
value times the weights before it, less the weighted values before it. ``|x_i + x_j|`` is a gap too,
between the values and their negatives. All sums of a table are taken in one scan of one long
relation (group, sum, value, weights); a group too large for a task is cut into range partitions
whose totals are carried on.

The least distance is found on a grid that shrinks with the data: two of n points in a box share one of
fewer than n equal boxes, so its diagonal bounds the distance. Cells as wide as the bound give better
bounds by their own points, until no cell holds more than a few; then only neighbouring cells meet.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks.operators import scan
from moundworks.storage import cut_lineage

#: Cells are made smaller than the bound by no rounding.
MARGIN = 1 + 1e-9
#: Cells that meet are so many bounds wide, so that few points lie within the bound of a neighbouring cell.
WIDE = 3
SIDES = ["wa", "sa", "wb", "sb"]


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by ``keys``, where NULL keys are groups like any other."""
    named = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys))
    return left.join(named, same, how).drop(*[f"right_{k}" for k in keys])


def _items(weight: Column, gaps: dict[str, str], mirrored: dict[str, str]) -> Column:
    """A row's entries: value, weights on either side, and what the row adds with itself."""
    def item(out: str, value: Column, a: Column, b: Column, own: Column) -> Column:
        return F.struct(F.lit(out).alias("measure"), value.alias("z"), a.alias("wa"), b.alias("wb"),
                        (value * a).alias("sa"), (value * b).alias("sb"), own.alias("own"))

    none, items = F.lit(0.0), []
    for out, column in gaps.items():
        items.append(item(out, F.col(column).cast("double"), weight, weight, none))
    for out, column in mirrored.items():
        x = F.col(column).cast("double")
        items += [item(out, x, weight, none, weight * weight * 2 * F.abs(x)), item(out, -x, none, weight, none)]
    return F.array(*items)


def pair_sums(df: DataFrame, keys: list[str], weight: str, gaps: dict[str, str],
              mirrored: dict[str, str] | None = None, task_rows: int | None = None) -> DataFrame:
    """Per group the sums over unordered pairs of ``w_i w_j |x_i - x_j|`` (``gaps``: output -> column) and
    of ``w_i w_j |x_i + x_j|`` (``mirrored``).

    Rows without a weight or value have no part in that sum; groups of one, or of unknown values,
    get 0.
    """
    mirrored, task_rows = mirrored or {}, task_rows or scan.TASK_ROWS
    items = _items(F.col(weight).cast("double"), gaps, mirrored)
    rows = df.select(*keys, F.explode(items).alias("item")).select(*keys, "item.*").where(
        F.col("z").isNotNull() & F.col("wa").isNotNull() & F.col("wb").isNotNull())
    group = [*keys, "measure"]
    if scan._largest_group(rows, group) <= task_rows:
        part, carried = [], None
    else:
        rows = scan._ranged(rows, group, ["z"], "part", "copy", task_rows)
        part = ["part"]
        # one row per group and range partition
        runs = rows.groupBy(*group, "part").agg(*[F.sum(c).alias(c) for c in SIDES])
        earlier = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        carried = runs.select(*group, "part", *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"{c}_carried") for c in SIDES])
    before = W.partitionBy(*group, *part).orderBy("z").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in SIDES})
    at = {c: F.col(f"{c}_before") for c in SIDES}
    if carried is not None:
        rows = _join(rows, carried, [*group, "part"])
        at = {c: at[c] + F.col(f"{c}_carried") for c in SIDES}
    z = F.col("z")
    term = F.col("wa") * (z * at["wb"] - at["sb"]) + F.col("wb") * (z * at["wa"] - at["sa"]) - F.col("own")
    summed = rows.withColumn("term", term).groupBy(*keys).agg(*[
        (F.sum(F.when(F.col("measure") == out, F.col("term"))) / 2).alias(out) for out in [*gaps, *mirrored]])
    return _join(df.select(*keys).distinct(), summed, keys, "left").select(
        *keys, *[F.coalesce(out, F.lit(0.0)).alias(out) for out in [*gaps, *mirrored]])


def _shared_box(count: Column, sides: list[Column]) -> Column:
    """A distance that some two of ``count`` points in a box do not exceed; NULL for fewer than two."""
    per_side = F.floor(F.pow(count - 1, F.lit(1 / len(sides))) + 1e-9)
    return F.when(count > 1, F.sqrt(sum((s * s for s in sides), F.lit(0.0))) / per_side)


def _boxes(points: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    boxed = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"{c}_low") for c in columns],
        *[(F.max(c) - F.min(c)).alias(f"{c}_side") for c in columns])
    return boxed.withColumn("bound", _shared_box(F.col("n"), [F.col(f"{c}_side") for c in columns]))


def _celled(points: DataFrame, groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Points of groups of several, with the cell of width ``bound`` they lie in."""
    placed = _join(points.drop("copies"), groups, keys).where("bound > 0")
    return placed.select(
        *keys, *columns, *[f"{c}_low" for c in columns], "bound",
        *[F.floor(_place(c, 1)).alias(f"{c}_cell") for c in columns])


def _place(column: str, bounds: int) -> Column:
    """Where a coordinate lies, counted in cells of so many bounds."""
    return (F.col(column) - F.col(f"{column}_low")) / (F.col("bound") * (MARGIN * bounds))


def _reaches(column: str, step: Column) -> Column:
    """A neighbouring cell of width ``WIDE`` may hold points within the bound; roundings only add some."""
    at = F.col(f"{column}_place")
    inside, near = at - F.floor(at), 1 / WIDE + 1e-6 + at * 1e-15
    return F.when(step < 0, inside <= near).when(step > 0, inside >= 1 - near).otherwise(True)


def closest_pairs(df: DataFrame, keys: list[str], columns: list[str], out: str,
                  cell_rows: int | None = None) -> DataFrame:
    """Per group the least Euclidean distance of two rows; 0 for groups of one.

    Rows with an unknown or infinite coordinate have no part. ``cell_rows`` bounds a cell; a cell of
    more points halves the bound at least.
    """
    d = len(columns)
    cell_rows = cell_rows or math.ceil((2 * math.sqrt(d)) ** d) + 1
    known = reduce(lambda a, b: a & b, (F.abs(F.col(c).cast("double")) < float("inf") for c in columns))
    points = df.where(known).select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    points = cut_lineage(points.groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("copies")))
    groups = cut_lineage(_boxes(points, keys, columns))
    lows = [f"{c}_low" for c in columns]
    while True:
        cells = _boxes(_celled(points, groups, keys, columns), [*keys, *[f"{c}_cell" for c in columns]], columns)
        better = cells.groupBy(*keys).agg(F.min("bound").alias("better"), F.max("n").alias("most"))
        groups = cut_lineage(_join(groups, better, keys, "left").select(
            *keys, *lows, F.least("bound", "better").alias("bound"), "most"))
        largest = groups.agg(F.max("most")).first()[0] or 0
        groups = groups.drop("most")
        if largest <= cell_rows:
            break
    places = [_place(c, WIDE).alias(f"{c}_place") for c in columns]
    cells = _celled(points, groups, keys, columns).select(*keys, *columns, *places).withColumns(
        {f"{c}_cell": F.floor(f"{c}_place") for c in columns})
    # of two neighbouring cells one asks the other; within a cell the smaller point asks
    steps = [s for s in product((-1, 0, 1), repeat=d) if s >= (0,) * d]
    offsets = F.array(*[F.array(*[F.lit(i) for i in s]) for s in steps])
    reached = reduce(lambda a, b: a & b, (_reaches(c, F.col("step")[i]) for i, c in enumerate(columns)))
    asks = cells.withColumn("step", F.explode(offsets)).where(reached).select(
        *[F.col(k).alias(f"ask_{k}") for k in keys], *[F.col(c).alias(f"ask_{c}") for c in columns],
        *[(F.col(f"{c}_cell") + F.col("step")[i]).alias(f"ask_{c}_cell") for i, c in enumerate(columns)],
        reduce(lambda a, b: a & b, (F.col("step")[i] == 0 for i in range(d))).alias("inside"))
    meet = reduce(lambda a, b: a & b, [
        *[F.col(k).eqNullSafe(F.col(f"ask_{k}")) for k in keys],
        *[F.col(f"{c}_cell") == F.col(f"ask_{c}_cell") for c in columns]])
    later = ~F.col("inside") | (F.struct(*columns) > F.struct(*[f"ask_{c}" for c in columns]))
    apart = F.sqrt(sum(((F.col(c) - F.col(f"ask_{c}")) * (F.col(c) - F.col(f"ask_{c}")) for c in columns), F.lit(0.0)))
    least = cells.drop(*[f"{c}_place" for c in columns]).join(asks, meet & later).groupBy(*keys).agg(F.min(apart).alias("least"))
    copied = points.groupBy(*keys).agg(F.max("copies").alias("copies"))
    found = _join(_join(df.select(*keys).distinct(), copied, keys, "left"), least, keys, "left")
    return found.select(*keys, F.when(F.col("copies") > 1, 0.0).otherwise(
        F.coalesce("least", F.lit(0.0))).alias(out))
