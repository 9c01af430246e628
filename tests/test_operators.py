"""Operators against numpy, with the edge cases of small groups."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.operators import forest_walk, learn, metrics, pairs
from moundworks.operators import states as G
from moundworks.operators.quantile import exact_quantile
from moundworks.plans import stuff
from moundworks.storage import sized_lookup


def frame(spark, pdf):
    rows = [tuple(None if pd.isna(v) else v for v in r)
            for r in pdf.astype(object).itertuples(index=False)]
    kinds = {"i": "long", "f": "double", "O": "string"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[pdf[c].dtype.kind]}" for c in pdf))


def test_rate_metric_drops_null_keys_and_small_groups(spark):
    rows = [("a", 1)] * 3 + [("a", 0)] * 2 + [("b", 1)] * 2 + [(None, 1)] * 9
    df = spark.createDataFrame(rows, "k string, hit int")
    got = metrics.rate_metric(df, ["k"], count=("n", F.col("hit")), hits=("h", F.col("hit")),
                              rate="r", min_count=3).collect()
    assert [tuple(r) for r in got] == [("a", 5, 3, 0.6)]


def test_plus_score_by_group(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("one", 3.0), ("same", 2.0), ("same", 2.0),
            ("a", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = metrics.plus_score(df, {"up": "x", "down": "x"}, ["g"], invert={"down"}).toPandas()
    a = got[(got.g == "a") & got.x.notna()]
    assert a["up"].mean() == pytest.approx(100) and a["up"].std(ddof=1) == pytest.approx(10)
    np.testing.assert_allclose(a["up"] + a["down"], 200)
    assert got[got.g != "a"]["up"].isna().all() and len(got) == len(rows)


def test_global_scores(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = frame(spark, pd.DataFrame({"x": x}))
    plus = metrics.plus_score(df, {"p": "x"}).orderBy("x").toPandas()["p"]
    np.testing.assert_allclose(plus, 100 + 10 * (x - x.mean()) / x.std(ddof=1))
    z = metrics.z_score(df, {"z": "x"}).orderBy("x").toPandas()["z"]
    np.testing.assert_allclose(z, (x - x.mean()) / x.std())
    flat = metrics.z_score(df.withColumn("x", F.lit(3.0)), {"z": "x"}).toPandas()["z"]
    np.testing.assert_array_equal(flat, 0)


def test_combine_metrics_is_planned_as_inner_joins(spark):
    tables = [spark.createDataFrame([(1, v), (v, 9)], f"k int, m{v} int") for v in (2, 3, 4)]
    joined = metrics.combine_metrics(tables, ["k"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "Inner" in plan
    assert [tuple(r) for r in joined.collect()] == [(1, 2, 3, 4)]


def test_sized_lookup_broadcasts_only_small_tables(spark):
    facts, table = spark.range(100), spark.range(50).withColumn("v", F.lit(1))
    small = facts.join(sized_lookup(table, 50), "id")._jdf.queryExecution()
    assert "broadcast" in small.analyzed().toString().lower()
    large = facts.join(sized_lookup(table, 49), "id")._jdf.queryExecution()
    assert "broadcast" not in large.analyzed().toString().lower()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("small", [1_000_000, 20])
def test_exact_quantile(spark, q, small):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(400), rng.normal(size=333), rng.normal(size=50) * 1e6])
    df = frame(spark, pd.DataFrame({"x": x})).unionByName(
        spark.createDataFrame([(None,)], "x double"))
    assert exact_quantile(df, "x", q, small) == pytest.approx(np.quantile(x, q), rel=1e-12)


def test_exact_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_standardize_and_pca_norm(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 5)) + 0.2 * rng.normal(size=(300, 5)) + 7
    columns = list("abcde")
    df = frame(spark, pd.DataFrame(x, columns=columns).assign(i=np.arange(300)))
    z = (x - x.mean(0)) / x.std(0)
    got = learn.standardize(df, columns).orderBy("i").toPandas()[[f"{c}_z" for c in columns]]
    np.testing.assert_allclose(got, z, atol=1e-10)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    expected = np.linalg.norm(z @ axes[:3].T, axis=1)
    norm = learn.pca_norm(df, columns, "n", 3).orderBy("i").toPandas()["n"]
    np.testing.assert_allclose(norm, expected, atol=1e-9)
    assert learn.pca_norm(df.where("i < 0"), columns, "n").count() == 0


def brute_ridge(x, y, alphas, k):
    """Row-level cross validation: contiguous folds, centred closed form, mean R^2."""
    def fit(xs, ys, alpha):
        mx, my = xs.mean(0), ys.mean()
        w = np.linalg.solve((xs - mx).T @ (xs - mx) + alpha * np.eye(x.shape[1]), (xs - mx).T @ (ys - my))
        return w, my - mx @ w
    folds = np.array_split(np.arange(len(y)), k)
    scores = []
    for alpha in alphas:
        r2 = []
        for fold in folds:
            rest = np.setdiff1d(np.arange(len(y)), fold)
            w, b = fit(x[rest], y[rest], alpha)
            error = ((y[fold] - x[fold] @ w - b) ** 2).sum()
            r2.append(1 - error / ((y[fold] - y[fold].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    best = alphas[int(np.argmax(scores))]
    return best, *fit(x, y, best)


@pytest.mark.parametrize("n, p, seed", [(83, 1, 1), (62, 3, 2), (101, 6, 3)])
def test_ridge_cv(spark, n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * 3 + 50
    y = x @ rng.normal(size=p) + rng.normal(size=n) * 4 + 10
    features = [f"f{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=features).assign(y=y, a=np.arange(n) // 2, b=np.arange(n) % 2)
    extra = pdf.iloc[:4].assign(y=np.nan, a=10_000)  # rows without a target take no part
    df = frame(spark, pd.concat([pdf, extra]).sample(frac=1, random_state=0))
    model = learn.ridge_cv(df, features, "y", ["a", "b"])
    alpha, weights, intercept = brute_ridge(x, y, learn.ALPHAS, 5)
    assert model.alpha == pytest.approx(alpha)
    np.testing.assert_allclose(model.coefficients, weights, rtol=1e-8)
    assert model.intercept == pytest.approx(intercept, rel=1e-8)
    predicted = model.predict(df.where("y IS NOT NULL"), "p").orderBy("a", "b").toPandas()["p"]
    np.testing.assert_allclose(predicted, x @ weights + intercept, rtol=1e-9)


def test_ridge_without_enough_rows_predicts_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], "x double, y double, k int")
    model = learn.ridge_cv(df, ["x"], "y", ["k"])
    assert model.alpha is None and model.predict(df, "p").first()["p"] is None


def test_pair_interactions(spark):
    rng = np.random.default_rng(11)
    rows = [(g, t, *rng.normal(size=4).round(3).tolist(), float(rng.random()))
            for g, size in (("a", 4), ("b", 2), ("solo", 1)) for t in "wxyz"[:size]]
    columns = ["g", "t", "u", "v", "ang", "m", "w"]
    df = spark.createDataFrame(rows, columns)
    got = {r["g"]: r for r in pairs.pair_interactions(
        df, ["g"], "t", "w",
        {"gap": pairs.gap("u"), "tunnel": pairs.tunnel("ang", "u", "v"), "mirror": pairs.mirrored("m")},
        {"near": pairs.distance("u", "v")}).collect()}
    pdf = pd.DataFrame(rows, columns=columns)
    for g, group in pdf.groupby("g"):
        total = dict(gap=0.0, tunnel=0.0, mirror=0.0)
        near = []
        for (_, a), (_, b) in itertools.combinations(group.iterrows(), 2):
            w, apart = a.w * b.w, np.hypot(a.u - b.u, a.v - b.v)
            total["gap"] += abs(a.u - b.u) * w
            total["tunnel"] += apart / (1 + abs(a.ang - b.ang)) * w
            total["mirror"] += abs(a.m + b.m) * w
            near.append(apart)
        for name, value in {**total, "near": min(near, default=0.0)}.items():
            assert got[g][name] == pytest.approx(value)


def test_win_expectancy_from_rows(spark):
    rng = np.random.default_rng(2)
    n = 900
    pdf = pd.DataFrame({
        "game_pk": np.where(np.arange(n) < 300, 1, rng.integers(2, 9, n)), "inning": rng.integers(1, 3, n),
        "is_top": rng.integers(0, 2, n), "score_diff": rng.integers(-1, 2, n),
        "outs_when_up": rng.integers(0, 2, n), "base_state": 0,
        "home_score": rng.integers(0, 5, n), "away_score": rng.integers(0, 5, n)})
    state = ["inning", "is_top", "score_diff", "outs_when_up", "base_state"]
    final = pdf.groupby("game_pk")[["home_score", "away_score"]].transform("max")
    top, home, away = pdf.is_top == 1, final.home_score, final.away_score
    pdf["won"] = ((top & (home > away)) | (~top & (away > home))).astype(int)
    expected = pdf.groupby(state)["won"].agg(["mean", "count"]).query("count >= 20").reset_index()
    got = G.win_expectancy(frame(spark, pdf.drop(columns="won")), 20).orderBy(*state).toPandas()
    np.testing.assert_array_equal(got[state], expected[state])
    np.testing.assert_allclose(got["win_prob"], expected["mean"])


def test_forest_is_repeatable_and_neutralises_features(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"kind": np.where(np.arange(n) % 2, "a", "b"), "x": rng.random(n),
                        "y": rng.random(n), "i": np.arange(n)})
    pdf["t"] = pdf.x * 2 + (pdf.kind == "a")
    df = frame(spark, pdf)

    def run(rows, **options):
        return learn.fit_predict_by_group(
            rows, "kind", ["x", "y"], "t", {"full": ["x", "y"], "x_only": ["x"], "y_only": ["y"]}, key=["i"],
            trees=10, depth=4, min_leaf=5, **options).orderBy("i").toPandas()

    one = run(df.coalesce(1))
    pd.testing.assert_frame_equal(one, run(df.coalesce(1)))
    pd.testing.assert_frame_equal(one, run(df.repartition(7).orderBy(F.rand(3))))
    pd.testing.assert_frame_equal(one, run(df.repartition(3, "x"), node_cache_rows=10))
    assert one.groupby("kind")["full"].mean().values == pytest.approx(pdf.groupby("kind")["t"].mean().values, rel=0.05)
    assert one[one.kind == "a"]["y_only"].std() < 0.2 * one[one.kind == "a"]["x_only"].std()
    assert learn.fit_predict_by_group(df.where("i < 0"), "kind", ["x"], "t", {"f": ["x"]}) is None


@pytest.mark.parametrize("trees, depth", [(1, 0), (7, 1), (20, 5)])
def test_one_walk_gives_the_predictions_of_the_forest(spark, trees, depth):
    """Bit by bit those of the library, view by view."""
    rng = np.random.default_rng(8)
    names = ["x", "y", "z"]
    pdf = pd.DataFrame({c: rng.normal(size=400).round(1) for c in names})
    pdf["t"] = pdf.x * pdf.y + (pdf.z > 0.3) + rng.normal(size=400) * 0.1
    df = frame(spark, pdf).repartition(3)
    means = [float(v) for v in pdf[names].mean()]
    assemble = VectorAssembler(inputCols=names, outputCol="features").transform
    model = RandomForestRegressor(labelCol="t", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=3).fit(assemble(df))
    views = {"all": {0, 1, 2}, "x_z": {0, 2}, "y_only": {1}, "none": set()}
    flat = forest_walk.flattened(forest_walk.stored_nodes(spark, model), views, means)
    got = forest_walk.walked(df, names, flat).toPandas()
    for out, kept in views.items():
        seen = pd.DataFrame({c: got[c] if i in kept else means[i] for i, c in enumerate(names)}, index=got.index)
        want = model.transform(assemble(frame(spark, seen).coalesce(1))).select("prediction").toPandas()["prediction"]
        np.testing.assert_array_equal(got[out], want)
    assert forest_walk.walked(df.where("x > 99"), names, flat).count() == 0


def test_forest_facts_are_red_for_a_constant(spark):
    """The mean target of each type in place of the three predictions, and a forest's own."""
    rng = np.random.default_rng(9)
    n = 3_000
    pdf = pd.DataFrame({c: rng.normal(size=n) for c in S.STUFF_FEATURES})
    pdf["pitcher"], pdf["game_year"] = rng.integers(0, 40, n), 2024
    pdf["pitch_type"] = np.where(rng.random(n) < 0.5, "FF", "SL")
    pdf["velo"] = pdf["velo"].round(1)
    pdf["velo_sq"] = pdf["velo"] ** 2
    pdf["target"] = np.sin(pdf["velo"]) + pdf["ivb"] + rng.normal(size=n) * 0.3
    for i, c in enumerate(S.PITCH_KEY):
        if c != "pitcher":
            pdf[c] = np.arange(n) * (i + 1)
    matrix = frame(spark, pdf)
    learned = stuff.predictions(matrix, trees=5, depth=5, min_leaf=20).cache()
    names = ["unbiased", "better_than_mean", "shape_counts", "velocity_counts", "velocity_alone"]
    facts = stuff.forest_facts(learned, stuff.stuff_plus(learned)).collect()
    assert len(facts) == 2 and all(r[c] for r in facts for c in names)
    mean = learned.groupBy("pitch_type").agg(F.avg("target").alias("mean"))
    constant = learned.join(mean, "pitch_type").withColumns({c: F.col("mean") for c in stuff.PREDICTIONS.values()})
    for r in stuff.forest_facts(constant, stuff.stuff_plus(constant)).collect():
        assert not (r["better_than_mean"] or r["shape_counts"] or r["velocity_counts"])
