"""Statistical operators: standardisation, principal components, ridge and forests."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.operators.forest_grow import GROUPS_AT_ONCE, Group, group_number, grow_forests, row_hash
from moundworks.operators.forest_walk import flattened, walked_by_group
from moundworks.operators.metrics import known, z_score
from moundworks.operators.scan import contiguous_folds
from moundworks.storage import cut_lineage

ALPHAS = np.logspace(-3, 3, 50)
# a forest per group is one fit after the other; more groups than this are no forest's case
MAX_FORESTS = 1_000


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean of every column."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def standardize(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Zero mean and unit population deviation over the whole table."""
    return z_score(df, {f"{c}{suffix}": c for c in columns}, ddof=0)


# --- principal components -------------------------------------------------------------------

@dataclass
class Components:
    """Means, population deviations and first principal axes (one column each) of ``columns``."""
    columns: list[str]
    means: list[float]
    deviations: list[float]
    axes: np.ndarray


def principal_components(df: DataFrame, columns: list[str], k: int) -> Components | None:
    """Components of the standardised columns, from one aggregation over the table.

    What reaches the driver depends on the number of columns only.
    """
    p, pairs = len(columns), list(combinations(range(len(columns)), 2))
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns],
                 *[F.corr(columns[i], columns[j]) for i, j in pairs]).first()
    if row is None or row[0] is None:
        return None
    matrix = np.diag([1.0 if sd else 0.0 for sd in row[p:2 * p]])
    for (i, j), value in zip(pairs, row[2 * p:]):
        matrix[i, j] = matrix[j, i] = value if value is not None and np.isfinite(value) else 0.0
    _, vectors = np.linalg.eigh(matrix)
    return Components(columns, list(row[:p]), list(row[p:2 * p]), vectors[:, ::-1][:, :k])


def linear(columns: list[str], weights, intercept: float = 0.0) -> Column:
    """Linear combination as one generated expression."""
    return reduce(lambda acc, cw: acc + F.col(cw[0]) * F.lit(float(cw[1])),
                  zip(columns, weights), F.lit(float(intercept)))


def pca_norm(df: DataFrame, columns: list[str], out: str, k: int = 3) -> DataFrame:
    """Length of each row's score vector on the first ``k`` principal components."""
    found = principal_components(df, columns, k)
    if found is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    scaled = [f"{c}_pca" for c in columns]
    centred = {z: (F.col(c) - F.lit(m)) / F.lit(sd or 1.0)
               for z, c, m, sd in zip(scaled, columns, found.means, found.deviations)}
    scores = [f"{out}_score{i}" for i in range(k)]
    return (df.withColumns(centred)
            .withColumns({s: linear(scaled, found.axes[:, i]) for i, s in enumerate(scores)})
            .withColumn(out, F.sqrt(reduce(lambda a, b: a + b, (F.col(s) * F.col(s) for s in scores))))
            .drop(*scaled, *scores))


# --- ridge with cross validation ------------------------------------------------------------

@dataclass
class RidgeModel:
    features: list[str]
    alpha: float | None = None
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.alpha is None:
            return df.withColumn(out, F.lit(None).cast("double"))
        return df.withColumn(out, linear(self.features, self.coefficients, self.intercept))

    def report(self, name: str) -> list[tuple]:
        return [(name, self.alpha, f, c) for f, c in zip(self.features, self.coefficients)]


def weight_report(spark: SparkSession, models: dict[str, RidgeModel]) -> DataFrame:
    """Chosen alpha and coefficient per feature of each model."""
    rows = [row for name, model in models.items() for row in model.report(name)]
    return spark.createDataFrame(
        rows, "model string, alpha double, feature string, coefficient double")


class _Moments:
    """Count, sums and sums of products of (features, label), additive over folds."""

    def __init__(self, n: float, sums: np.ndarray, products: np.ndarray):
        self.n, self.sums, self.products = n, sums, products

    def __add__(self, other):
        return _Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other):
        return _Moments(self.n - other.n, self.sums - other.sums, self.products - other.products)

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        means = self.sums / self.n
        centred = self.products - self.n * np.outer(means, means)
        p = len(means) - 1
        weights = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])
        return weights, means[p] - means[:p] @ weights

    def r_squared(self, weights: np.ndarray, intercept: float) -> float:
        """1 - residual / total sum of squares of the rows behind these moments."""
        direction = np.append(-weights, 1.0)
        residual = (direction @ self.products @ direction
                    - 2 * intercept * direction @ self.sums + self.n * intercept ** 2)
        total = self.products[-1, -1] - self.sums[-1] ** 2 / self.n
        if total <= 0:
            return 1.0 if residual <= 0 else 0.0
        return 1.0 - residual / total


def ridge_cv(df: DataFrame, features: list[str], label: str, order_by: list[str],
             alphas: np.ndarray = ALPHAS, k: int = 5) -> RidgeModel:
    """Ridge with an unpenalised intercept; alpha by the best mean R^2 of ``k`` ordered folds.

    One aggregation yields the moments of every fold (k rows, p^2 numbers); all k * len(alphas)
    fits are solved from them. Columns are centred first so the sums keep their precision.
    Rows with a NULL feature or label take no part; their prediction is NULL.
    """
    columns = [*features, label]
    rows = cut_lineage(df.where(known(*columns)).select(*order_by, *columns))  # read three times
    n, *centre = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()
    if n < k or any(v is None for v in centre):
        return RidgeModel(features)
    folded = contiguous_folds(rows, "fold", order_by, k, n).withColumns(
        {c: F.col(c) - F.lit(m) for c, m in zip(columns, centre)})
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    sums = folded.groupBy("fold").agg(
        F.count(F.lit(1)), *[F.sum(c) for c in columns],
        *[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs])
    folds = []
    for row in sorted(sums.collect()):
        products = np.zeros((len(columns), len(columns)))
        for (i, j), value in zip(pairs, row[2 + len(columns):]):
            products[i, j] = products[j, i] = value
        folds.append(_Moments(row[1], np.array(row[2:2 + len(columns)]), products))
    every = reduce(lambda a, b: a + b, folds)
    scores = [np.mean([fold.r_squared(*(every - fold).solve(alpha)) for fold in folds])
              for alpha in alphas]
    best = float(alphas[int(np.argmax(scores))])
    weights, intercept = every.solve(best)
    intercept = centre[-1] + intercept - float(np.dot(weights, centre[:-1]))
    return RidgeModel(features, best, [float(w) for w in weights], float(intercept))


def residual(df: DataFrame, label: str, base: str, out: str,
             order_by: list[str]) -> tuple[DataFrame, RidgeModel]:
    """What is left of ``label`` after a ridge regression on ``base``."""
    model = ridge_cv(df, [base], label, order_by)
    fitted = model.predict(df, f"{out}_fitted")
    return fitted.withColumn(out, F.col(label) - F.col(f"{out}_fitted")).drop(f"{out}_fitted"), model


# --- forests --------------------------------------------------------------------------------

def fit_predict_by_group(matrix: DataFrame, group: str, features: list[str], label: str,
                         views: dict[str, list[str]], *, key: list[str] = (), trees: int = 120,
                         depth: int = 8, min_leaf: int = 75, bins: int = 32, seed: int = 42,
                         parallel: int = 2, node_cache_rows: int = 20_000_000,
                         kept: list[str] | None = None) -> DataFrame | None:
    """A random forest per ``group`` value and its predictions on its own rows.

    ``views`` maps an output column to the features that keep their values in it; the others are
    set to their mean over all groups. ``matrix`` should be a stored table, as it is read several times; ``kept``
    names the columns that stay beside the predictions, all unless it is given. The forests of all groups grow
    together, a job per level (``forest_grow``); they depend on the rows and on ``key``, which tells rows with
    equal features apart, but not on the order of rows.
    ``bins`` bounds the split candidates of a feature and one; an exact-split forest has one per value.
    ``parallel`` and ``node_cache_rows`` are taken from older callers and have no effect.
    More than ``MAX_FORESTS`` groups are refused, and missing values in what a forest reads.
    """
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in (*features, label)]
    hashed = row_hash(list(key), features, label)
    found = matrix.groupBy(group).agg(
        F.count("*"), F.count_distinct(hashed), F.min(label).cast("double"), F.max(label).cast("double"),
        F.max(reduce(lambda a, b: a | b, missing))).limit(MAX_FORESTS + 1).collect()
    if len(found) > MAX_FORESTS:
        raise ValueError(f"{group} has more than {MAX_FORESTS} values")
    if not found:
        return None
    if any(r[0] is None or r[5] for r in found):
        raise ValueError(f"{group}, the features and {label} must have values")
    found.sort(key=lambda r: (-r[1], r[0]))  # large ones first
    groups = {r[0]: Group(i, *r[1:5]) for i, r in enumerate(found)}
    means = column_means(matrix, features).first()
    cores = matrix.sparkSession.sparkContext.defaultParallelism
    nodes = grow_forests(matrix, group, groups, features, label, list(key), trees=trees, depth=depth,
                         min_leaf=min_leaf, bins=bins, seed=seed)

    kept_by_view = {out: {i for i, f in enumerate(features) if f in some} for out, some in views.items()}
    number, order = group_number(group, groups, matrix.schema[group].dataType), list(groups)
    if matrix.rdd.getNumPartitions() < cores:  # predictions do not depend on the layout
        matrix = matrix.repartition(cores)

    def predict(some: list) -> DataFrame:
        forests = {groups[v].index: flattened(nodes[v], kept_by_view, list(means)) for v in some}
        rows = matrix.where(number.isin(list(forests))) if len(some) < len(groups) else matrix
        return walked_by_group(rows, number, features, forests, kept or matrix.columns)

    return reduce(DataFrame.unionByName, [predict(order[a:a + GROUPS_AT_ONCE]) for a in range(0, len(order), GROUPS_AT_ONCE)])
