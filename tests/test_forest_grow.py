import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from moundworks.operators import forest_grow as grow
from moundworks.operators import learn

NAMES = ["x", "y"]


def _frame(spark, n=900):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"kind": np.where(np.arange(n) % 3, "a", "b"), "x": rng.normal(size=n).round(1), "y": rng.normal(size=n)})
    pdf["t"] = np.sin(3 * pdf.x) + (pdf.y > 0.4) * 2 - 1
    return spark.createDataFrame(pd.concat([pdf, pdf.head(300)]))  # rows that are equal in every column


def _nodes(rows, trees=4, depth=4, min_leaf=10):
    sizes = {r[0]: r[1:] for r in rows.groupBy("kind").agg(
        F.count("*"), F.count_distinct(grow.row_hash([], NAMES, "t")), F.min("t"), F.max("t")).collect()}
    groups = {v: grow.Group(i, *sizes[v]) for i, v in enumerate(sorted(sizes))}
    return grow.grow_forests(rows, "kind", groups, NAMES, "t", [], trees=trees, depth=depth, min_leaf=min_leaf, bins=8, seed=5)


def test_nodes_hold_the_weighted_means_of_their_rows(spark, monkeypatch):
    """Also of nodes that are derived from their parent and sibling, and over several blocks of rows."""
    rows = _frame(spark)
    whole = _nodes(rows)
    monkeypatch.setattr(grow, "SUMS_BYTES", 1)  # a job per tree
    assert _nodes(rows.repartition(5)) == whole
    monkeypatch.undo()
    pdf = rows.select("*", grow.row_hash([], NAMES, "t").alias("hash")).toPandas()
    pdf["nth"] = pdf.groupby(["kind", "hash"]).cumcount()
    seeds = grow.mixed(pdf["hash"].to_numpy().view(np.uint64) + pdf["nth"].to_numpy().astype(np.uint64) * np.uint64(grow.STEP))
    for kind, nodes in whole.items():
        for tree in range(4):
            weight = grow.weights(seeds, tree, 5) * (pdf["kind"] == kind).to_numpy()
            by_id = {n[1]: n[2:] for n in nodes if n[0] == tree}
            assert 5 < len(by_id) < 32

            def check(i, here):
                value, left, right, feature, threshold = by_id[i]
                drawn = weight * here
                assert drawn.sum() >= 10
                assert value == pytest.approx((drawn * pdf["t"]).sum() / drawn.sum(), abs=1e-9)
                if left >= 0:
                    low = (pdf[NAMES[feature]] <= threshold).to_numpy()
                    check(left, here & low)
                    check(right, here & ~low)
            check(0, np.full(len(pdf), True))


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(7)
    found = np.stack([rng.integers(0, 9, (3, 5, 6)), rng.integers(0, 50, (3, 5, 6))]).astype(float)
    order = [rng.permutation(6) for _ in range(3)]
    found = np.stack([found[:, 0][:, :, o] for o in order], 1)  # features share their node's rows
    splits = grow.best_splits(found, 4)
    for node in range(5):
        best = (0.0, -1, 0)
        for f in range(3):
            w, s = found[:, f, node]
            for k in range(5):
                a, b = w[:k + 1].sum(), w[k + 1:].sum()
                if min(a, b) >= 4:
                    gain = s[:k + 1].sum() ** 2 / a + s[k + 1:].sum() ** 2 / b - s.sum() ** 2 / w.sum()
                    best = max(best, (gain, f, k), key=lambda g: round(g[0], 9))
        assert tuple(splits[:2, node]) == best[1:]


def test_weights_are_poisson_and_differ_by_tree():
    drawn = grow.weights(grow.mixed(np.arange(200_000, dtype=np.uint64)), 3, 42)
    assert drawn.mean() == pytest.approx(1, abs=0.01) and drawn.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(drawn, grow.weights(grow.mixed(np.arange(200_000, dtype=np.uint64)), 4, 42))[0, 1]) < 0.01


def test_candidates_lie_between_values_at_equal_shares():
    assert grow.candidates(np.array([3.0, 1.0, 1.0, 2.0]), np.ones(4), 4).tolist() == [1.5, 2.5]
    cuts = grow.candidates(np.arange(1000.0), np.ones(1000), 32)
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 1000 / 32).max() <= 1
    assert grow.candidates(np.array([5.0]), np.ones(1), 4).tolist() == []
    heavy = grow.candidates(np.arange(100.0), np.r_[1000.0, np.ones(99)], 4)
    assert heavy.tolist() == [0.5]


def test_jobs_of_a_forest_do_not_grow_with_groups(spark):
    """One job after another per group and level took most of the time of many cores."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(rows, name):
        spark.sparkContext.setJobGroup(name, name)
        try:
            learn.fit_predict_by_group(rows, "kind", NAMES, "t", {"p": NAMES}, trees=2, depth=3, min_leaf=5)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    rows = _frame(spark)
    many = rows.withColumn("kind", (F.abs(F.hash("x", "y")) % 8).cast("string"))
    assert jobs(many, "many") <= jobs(rows.withColumn("kind", F.lit("a")), "one") + 8


def test_missing_values_are_refused(spark):
    rows = _frame(spark, 60)
    for name in ("x", "t"):
        with pytest.raises(ValueError):
            learn.fit_predict_by_group(rows.withColumn(name, F.when(F.col("y") > 0, F.col(name))), "kind", NAMES, "t", {"p": NAMES})
