"""What keeps the work of forests in proportion to their rows."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moundworks.operators import forest_grow as grow
from moundworks.operators import forest_walk, learn


def _random_nodes(rng, trees, depth, n_features, thresholds=31):
    """Trees whose paths end early here and there."""
    nodes = []
    for t in range(trees):
        level, size = [0], 1
        for d in range(depth + 1):
            below = []
            for i in level:
                if d < depth and (d < 2 or rng.random() < 0.8):
                    nodes.append((t, i, 0.0, size, size + 1, int(rng.integers(n_features)), float(rng.integers(1, thresholds + 1))))
                    below += [size, size + 1]
                    size += 2
                else:
                    nodes.append((t, i, float(rng.normal()), -1, -1, -1, 0.0))
            level = below
    return nodes


def _plain(nodes, rows, kept, fixed):
    trees = {}
    for t, i, *node in nodes:
        trees.setdefault(t, {})[i] = node
    out = np.zeros(len(rows))
    for t in sorted(trees):
        for k, row in enumerate(rows):
            value, left, right, feature, threshold = trees[t][0]
            while left >= 0:
                x = row[feature] if feature in kept else fixed[feature]
                value, left, right, feature, threshold = trees[t][left if x <= threshold else right]
            out[k] += value
    return out / len(trees)


@pytest.mark.parametrize("depth", [0, 3, 5, 6, 9])
def test_predictions_are_those_of_single_steps(depth):
    rng = np.random.default_rng(depth)
    nodes, rows, fixed = _random_nodes(rng, 4, depth, 6), rng.integers(0, 330, (500, 6)) / 10, [7.0, 20.0, 3.5, 31.0, 1.0, 15.0]
    rows[::50, 2] = np.nan
    views = {"all": set(range(6)), "one": {2}, "none": set(), "four": {0, 1, 4, 5}}
    got = forest_walk.flattened(nodes, views, fixed).predict(rows)
    for v, kept in enumerate(views.values()):
        np.testing.assert_array_equal(got[:, v], _plain(nodes, rows, kept, fixed))


def test_a_view_of_few_combinations_walks_down_for_each_once(monkeypatch):
    rng = np.random.default_rng(1)
    forest = forest_walk.flattened(_random_nodes(rng, 3, 4, 3, 7), {"two": {0, 2}, "all": {0, 1, 2}}, [1.0, 2.0, 3.0])
    walked, walk = {0: 0, 1: 0}, forest_walk.FlatForest._walked

    def counted(self, view, codes):
        walked[view] += codes.shape[1]
        return walk(self, view, codes)

    monkeypatch.setattr(forest_walk.FlatForest, "_walked", counted)
    for _ in range(5):
        forest.predict(rng.integers(0, 9, (4000, 3)).astype(float))
    assert walked[0] <= 8 * 8 and walked[1] <= 8 ** 3


@pytest.mark.parametrize("level", [0, 2, 5, 6, 7])
def test_sums_of_a_level_are_those_of_single_rows(level):
    """By two features at a time or one, in steps by column or by row."""
    rng = np.random.default_rng(level)
    n, n_features, bins = 6000, 5, 8
    tree = grow.Tree()
    for d in range(level):
        before, tree.open, tree.counted = tree.open, [], []
        for node in before:
            if d < 2 or rng.random() < 0.8:
                children = [tree.add(0.0), tree.add(0.0)]
                tree.feature[node], tree.cut[node] = int(rng.integers(n_features)), int(rng.integers(bins - 1))
                tree.children[2 * node:2 * node + 2] = children
                tree.open += children
                tree.counted.append(children[int(rng.integers(2))])
    codes, labels = rng.integers(0, bins, (n_features, n)).astype("u1"), rng.integers(0, 1 << 30, n).astype(float)
    seeds = grow.mixed(rng.integers(0, 1 << 62, n).astype(np.uint64))
    batch = pa.RecordBatch.from_pylist([{"group": 0, "n": n, "codes": codes.tobytes(), "labels": labels.tobytes(),
                                         "seeds": seeds.tobytes()}])
    out = list(grow.level_sums(iter([batch]), {0: {3: tree.walked_by("u1")}}, level, n_features, bins, "u1", 42))
    got = np.frombuffer(out[0].column("sums")[0].as_py()).reshape(2, n_features, len(tree.counted), bins)
    want, weight = np.zeros_like(got), grow.weights(seeds, 3, 42)
    for i in range(n):
        node = 0
        for _ in range(level):
            node = tree.children[2 * node + int(codes[tree.feature[node], i] > tree.cut[node])]
        if node in tree.counted:
            for f in range(n_features):
                want[:, f, tree.counted.index(node), codes[f, i]] += weight[i], weight[i] * labels[i]
    np.testing.assert_array_equal(got, want)


def test_parts_follow_the_rows_of_groups():
    def groups(*rows):
        return {i: grow.Group(i, n, n, 0.0, 1.0) for i, n in enumerate(rows)}

    parts, n = grow.parts_of(groups(4_000_000, 2_700_000, 2_700_000, 1_300_000, 1_300_000, 90_000, 20_000), 8)
    assert n == 25 and [p[1] for p in parts.values()] == [8, 5, 5, 3, 3, 1, 1] and parts[5] == parts[6]
    assert grow.parts_of(groups(900_000, 600_000), 8)[1] == 8
    assert grow.parts_of(groups(100), 8) == ({0: (0, 1)}, 1)
    parts, n = grow.parts_of(groups(*[1000] * 1000), 8)
    assert n <= 2 * 8 + 1
    assert sorted({p[0] for p in parts.values()}) == list(range(n))


def test_all_groups_are_predicted_in_one_scan(spark):
    """Equal to predictions of each group by itself, and without columns that are not kept."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": range(1200), "kind": np.arange(1200) % 5, "x": rng.normal(size=1200), "y": rng.normal(size=1200)})
    pdf["t"] = pdf.x * pdf.kind + pdf.y
    df = spark.createDataFrame(pdf)

    def run(rows, **options):
        return learn.fit_predict_by_group(rows, "kind", ["x", "y"], "t", {"p": ["x", "y"], "q": ["x"]}, key=["i"],
                                          trees=5, depth=4, min_leaf=5, **options)

    scored = run(df, kept=["i", "kind"])
    assert scored.columns == ["i", "kind", "p", "q"]
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = scored.orderBy("i").toPandas()
    for kind in (0, 4):
        alone = run(df.where(F.col("kind") == kind)).orderBy("i").toPandas()
        np.testing.assert_array_equal(got.p[got.kind == kind], alone.p)
