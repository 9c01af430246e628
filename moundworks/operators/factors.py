"""Moments and triangular factors of many columns, by blocks of rows.

A block of rows is reduced to one square matrix: count, means and centred products (a Gram matrix), or
the R of a QR decomposition. Matrices of blocks are merged in a tree of shuffles, in which a task holds
one matrix of each group at a time; the driver gets one per group, whose size depends on the number of
columns only. No expression is written per pair of columns, so hundreds of columns are no limit.

Fits from R never form products of features, which would square their condition: features that nearly
agree keep the digits that an orthogonal solution has.

Cases: rows with a NULL, NaN or infinite value in one of the columns take no part; a table without
other rows has no matrix, no model and no correlations; a column without spread has no correlation;
groups are few, as folds are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.operators.learn import ALPHAS, Components, RidgeModel
from moundworks.operators.scan import contiguous_folds
from moundworks.storage import cut_lineage

#: Residues of the partition number that meet in the levels of the tree before the last one.
FAN = (1_024, 32)
#: Share of its mean by which a constant may seem to spread.
FLAT = 1e-13
STATE = "by long, part int, matrix binary"
Join = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _block_moments(x: np.ndarray) -> np.ndarray:
    """Count and means in the first row, centred products below it."""
    means = x.mean(0)
    out = np.zeros((x.shape[1] + 1, x.shape[1] + 1))
    out[0, 0], out[0, 1:], out[1:, 1:] = len(x), means, (x - means).T @ (x - means)
    return out


def _join_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, apart, out = a[0, 0] + b[0, 0], b[0, 1:] - a[0, 1:], a + b
    out[0, 1:] = a[0, 1:] + apart * (b[0, 0] / n)
    out[1:, 1:] += np.outer(apart, apart) * (a[0, 0] * b[0, 0] / n)
    return out


def _block_factor(x: np.ndarray) -> np.ndarray:
    """R of the columns behind a column of ones, whose first row is what centring takes off."""
    return np.linalg.qr(np.column_stack([np.ones(len(x)), x]), mode="r")


def _join_factors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate([a, b]), mode="r")


def _states(held: dict) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_pydict({
        "by": pa.array(list(held), pa.int64()), "part": pa.array([part] * len(held), pa.int32()),
        "matrix": pa.array([m.tobytes() for m in held.values()], pa.binary())})


def _add(held: dict, by, matrix: np.ndarray, join: Join) -> None:
    held[by] = join(held[by], matrix) if by in held else matrix


def _blocks(of_block: Callable[[np.ndarray], np.ndarray], join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False)
                                 for i in range(1, batch.num_columns)])
            complete = np.isfinite(x).all(1)
            groups, x = batch.column("by").to_numpy()[complete], x[complete]
            for by in np.unique(groups).tolist():
                _add(held, by, of_block(x[groups == by]), join)
        yield _states(held)
    return run


def _merger(join: Join, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for by, matrix in zip(batch.column("by").to_pylist(), batch.column("matrix")):
                _add(held, by, np.frombuffer(matrix.as_py()).reshape(-1, width), join)
        yield _states(held)
    return run


def _reduced(df: DataFrame, columns: list[str], by: str | None, of_block, join: Join) -> dict[int, np.ndarray]:
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    group = F.col(f"`{by}`").cast("long") if by else F.lit(0).cast("long")
    rows = df.select(group.alias("by"), *values).where("by IS NOT NULL")
    states = rows.mapInArrow(_blocks(of_block, join), STATE)
    merge = _merger(join, len(columns) + 1)
    for fan in FAN:
        states = states.repartition(F.pmod("part", F.lit(fan))).sortWithinPartitions("part", "by").mapInArrow(
            merge, STATE)
    last = states.repartition(1).sortWithinPartitions("part", "by").mapInArrow(merge, STATE)
    return {r["by"]: np.frombuffer(r["matrix"]).reshape(-1, len(columns) + 1) for r in last.collect()}


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> dict[int, np.ndarray]:
    """By group (0 without one): count and means in the first row, centred products below it."""
    return _reduced(df, columns, by, _block_moments, _join_moments)


def factors(df: DataFrame, columns: list[str], by: str | None = None) -> dict[int, np.ndarray]:
    """By group (0 without one): R of the QR decomposition of a column of ones and the columns."""
    return _reduced(df, columns, by, _block_factor, _join_factors)


def _deviations(found: np.ndarray) -> np.ndarray:
    """Population deviations; what rounding leaves of a constant is none."""
    deviations = np.sqrt(np.diag(found)[1:] / found[0, 0])
    return np.where(deviations > FLAT * np.abs(found[0, 1:]), deviations, 0.0)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n_rows, correlation) of every pair of columns, in their order."""
    found, rows = moments(df, columns).get(0), []
    if found is not None:
        spread = _deviations(found) * np.sqrt(found[0, 0])
        for i, j in zip(*np.triu_indices(len(columns), 1)):
            both = float(spread[i] * spread[j])
            rows.append((columns[i], columns[j], int(found[0, 0]),
                         float(found[1 + i, 1 + j]) / both if both else None))
    return df.sparkSession.createDataFrame(rows, "a string, b string, n_rows long, correlation double")


def principal_components(df: DataFrame, columns: list[str], k: int) -> Components | None:
    """Components of the standardised columns; one without spread has weight zero."""
    found = moments(df, columns).get(0)
    if found is None:
        return None
    deviations = _deviations(found)
    scale = np.where(deviations > 0, deviations, np.inf)
    _, vectors = np.linalg.eigh(found[1:, 1:] / found[0, 0] / np.outer(scale, scale))
    return Components(columns, found[0, 1:].tolist(), deviations.tolist(), vectors[:, ::-1][:, :k])


class _Fit:
    """Least squares of the last column on the others, with an unpenalised intercept, from R."""

    def __init__(self, r: np.ndarray):
        self.r = r
        centred = r[1:, 1:]
        u, self.singular, self.v = np.linalg.svd(centred[:, :-1], full_matrices=False)
        self.turned = u.T @ centred[:, -1]

    def solve(self, alpha: float) -> tuple[np.ndarray, float]:
        s = self.singular
        used = s > np.finfo(float).eps * max(self.r.shape) * (s[0] if len(s) else 0.0)
        weights = self.v[used].T @ (s[used] / (s[used] ** 2 + alpha) * self.turned[used])
        return weights, float(self.r[0, -1] - self.r[0, 1:-1] @ weights) / float(self.r[0, 0])


def _r_squared(r: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """1 - residual / total sum of squares of the rows behind a factor."""
    residual = float(np.sum((r @ np.concatenate([[-intercept], -weights, [1.0]])) ** 2))
    total = float(np.sum(r[1:, -1] ** 2))
    if total <= 0:
        return 1.0 if residual <= 0 else 0.0
    return 1.0 - residual / total


def least_squares(df: DataFrame, features: list[str], label: str) -> RidgeModel:
    """Without a penalty; of features that agree, the solution of least length."""
    r = factors(df, [*features, label]).get(0)
    if r is None:
        return RidgeModel(features)
    weights, intercept = _Fit(r).solve(0.0)
    return RidgeModel(features, 0.0, weights.tolist(), intercept)


def ridge_cv(df: DataFrame, features: list[str], label: str, order_by: list[str],
             alphas: np.ndarray = ALPHAS, k: int = 5) -> RidgeModel:
    """Ridge with an unpenalised intercept; alpha by the best mean R^2 of ``k`` ordered folds.

    One pass yields a factor per fold; all k * len(alphas) fits are solved from their decompositions.
    """
    columns = [*features, label]
    complete = F.forall(F.array(*[F.col(c).cast("double") for c in columns]),
                        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = cut_lineage(df.where(complete).select(*order_by, *columns))  # read twice
    n = rows.count()
    if n < k:
        return RidgeModel(features)
    found = factors(contiguous_folds(rows, "fold", order_by, k, n), columns, by="fold")
    trained = [(r, _Fit(reduce(_join_factors, [o for f, o in found.items() if f != fold])))
               for fold, r in sorted(found.items())]
    scores = [np.mean([_r_squared(r, *fit.solve(alpha)) for r, fit in trained]) for alpha in alphas]
    best = float(alphas[int(np.argmax(scores))])
    weights, intercept = _Fit(reduce(_join_factors, (found[f] for f in sorted(found)))).solve(best)
    return RidgeModel(features, best, weights.tolist(), intercept)
