"""Carry scans against a plain pandas loop, with limits that force every kind of run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moundworks.operators import scan

LIMITS = [{}, {"task_rows": 400}, {"task_rows": 40}]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [(g, a, n, int(rng.integers(0, 9)))
            for g in (1, 2, 5000, 9001) for a in range(1, 300 if g == 2 else 6)
            for n in range(1, int(rng.integers(2, 5)))]
    rows += [(3, 1, n, int(rng.integers(0, 9))) for n in range(1, 250)]  # one hot at bat
    pdf = pd.DataFrame(rows, columns=["game", "bat", "num", "v"])
    pdf.loc[pdf.index % 17 == 0, "v"] = None
    pdf = pdf.sort_values(["game", "bat", "num"], ignore_index=True)
    shuffled = pdf.sample(frac=1, random_state=1)
    clean = [tuple(None if pd.isna(x) else int(x) for x in r) for r in shuffled.itertuples(index=False)]
    return pdf, spark.createDataFrame(clean, "game long, bat long, num long, v long")


def result(df, out):
    return df.orderBy("game", "bat", "num").toPandas()[out].astype("float")


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("by_game", [True, False])
def test_ordered_delta(table, limits, by_game):
    pdf, df = table
    expected = (pdf.groupby("game")["v"].diff() if by_game else pdf["v"].diff()).fillna(0)
    order, keys = (["bat", "num"], ["game"]) if by_game else (["game", "bat", "num"], [])
    got = result(scan.ordered_delta(df, "v", "d", order, keys, **limits), "d")
    np.testing.assert_array_equal(got, expected)


@pytest.mark.parametrize("limits", LIMITS)
def test_sums(table, limits):
    pdf, df = table
    v = pdf["v"].fillna(0)
    running = v.groupby(pdf["game"]).cumsum()
    total = v.groupby(pdf["game"]).transform("sum")
    got = result(scan.running_sum(df, "v", "s", ["bat", "num"], ["game"], **limits), "s")
    np.testing.assert_array_equal(got, running)
    got = result(scan.sum_after(df, "v", "s", ["bat", "num"], ["game"], **limits), "s")
    np.testing.assert_array_equal(got, total - running)


@pytest.mark.parametrize("limits", LIMITS)
def test_row_position(table, limits):
    pdf, df = table
    got = result(scan.row_position(df, "at", ["game", "bat", "num"], **limits), "at")
    np.testing.assert_array_equal(got, np.arange(len(pdf)))


@pytest.mark.parametrize("n", [5, 7, 11, 23])
def test_folds_have_the_sizes_of_an_unshuffled_split(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("k"))
    folds = scan.contiguous_folds(df, "fold", ["k"], 5, n).orderBy("k").toPandas()["fold"]
    expected = np.concatenate([np.full(len(part), i) for i, part in enumerate(np.array_split(range(n), 5))])
    np.testing.assert_array_equal(folds, expected)


def test_positions_within_hot_keys(table):
    pdf, df = table
    got = scan.row_position(df, "at", ["bat", "num"], ["game"], task_rows=100)
    np.testing.assert_array_equal(result(got, "at"), pdf.groupby("game").cumcount())


def test_exact_copies_and_null_keys_spread_over_tasks(spark):
    copies = spark.range(3000).select(F.lit(1).alias("k"), F.lit(2).alias("o"))
    others = [(1, 1), (1, None), (1, 3), (2, 2), (None, 1), (None, 2)]
    df = copies.unionByName(spark.createDataFrame(others, "k int, o int"))
    got = scan.row_position(df, "at", ["o"], ["k"], task_rows=100).toPandas()
    one = got[got.k == 1].sort_values("at")
    assert list(one["at"]) == list(range(3003))
    assert list(one["o"].fillna(0)) == [0, 1] + [2] * 3000 + [3]
    assert list(got[got.k.isna()].sort_values("at")["o"]) == [1, 2]
    ranged = scan._ranged(df, ["k"], ["o"], "part", "copy", 100)
    assert ranged.groupBy("part").count().agg(F.max("count")).first()[0] < 300


def test_empty_input(table):
    _, df = table
    none = df.where("game < 0")
    assert scan.ordered_delta(none, "v", "d", ["bat", "num"], ["game"]).count() == 0
    assert scan.row_position(none, "at", ["game", "bat", "num"]).count() == 0
