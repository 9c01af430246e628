"""Pair sums and closest pairs of groups of any size against all pairs and against the fold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundworks.operators import pair_sums, pairs, scan

SCHEMA = "g long, h string, x double, y double, z double, w double"


def plain(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    def known(*v):
        return all(x is not None for x in v)
    result = {}
    for key, members in out.items():
        gap = mirror = 0.0
        least = None
        for (_, _, x, y, z, w), (_, _, x2, y2, z2, w2) in itertools.combinations(members, 2):
            if known(x, x2, w, w2):
                gap += w * w2 * abs(x - x2)
            if known(y, y2, w, w2):
                mirror += w * w2 * abs(y + y2)
            if known(x, x2, y, y2, z, z2):
                d = float(np.sqrt((x - x2) ** 2 + (y - y2) ** 2 + (z - z2) ** 2))
                least = d if least is None else min(least, d)
        result[key] = (gap, mirror, least or 0.0)
    return result


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in ((1, 300), (2, 40), (3, 1), (4, 2), (5, 120), (None, 30)):
        scale = (1.0, 1e-3, 1e4)[n % 3]
        for _ in range(n):
            x, y, z = rng.normal(50, 1, 3) * scale
            rows.append((g, "a", float(x), float(y), float(z), float(rng.uniform(0, 2))))
    # one dense cluster beside far points, ties, copies of a row, and unknown values
    rows += [(6, "b", float(v), 0.0, 0.0, 1.0) for v in rng.normal(0, 1e-6, 200)] + [(6, "b", 1e6, 1e6, 1e6, 1.0)]
    rows += [(7, "b", 1.0, 2.0, 3.0, 0.5)] * 5 + [(8, "b", None, 1.0, 1.0, 1.0), (8, "b", 2.0, None, 1.0, 1.0)]
    rows += [(9, "b", 1.0, -1.0, 0.0, None), (9, "b", 2.0, -2.0, 0.0, 1.0), (9, "b", 2.5, 3.0, 0.0, 1.0)]
    rows += [(10, None, float(i % 4), float(i), 0.0, 1.0) for i in range(50)]
    return rows


@pytest.mark.parametrize("task_rows", [None, 60, 7])
def test_sums_equal_all_pairs(spark, task_rows):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = pair_sums.pair_sums(df, ["g", "h"], "w", {"gap": "x"}, {"mirror": "y"}, task_rows).collect()
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        gap, mirror, _ = want[r["g"], r["h"]]
        assert r["gap"] == pytest.approx(gap, rel=1e-9, abs=1e-9) and r["mirror"] == pytest.approx(mirror, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("cell_rows", [None, 200])
def test_closest_equal_all_pairs(spark, cell_rows):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r["g"], r["h"]): r["least"] for r in pair_sums.closest_pairs(
        df, ["g", "h"], ["x", "y", "z"], "least", cell_rows).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for key, least in got.items():
        assert least == pytest.approx(want[key][2], rel=1e-12, abs=1e-15), key


def test_equal_to_the_fold_on_small_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, str(i), *map(float, rng.normal(size=3)), float(rng.uniform())) for g in range(40) for i in range(1 + g % 9)]
    df = spark.createDataFrame(rows, "g long, member string, x double, y double, z double, w double")
    fold = pairs.pair_interactions(df, ["g"], "member", "w", {"gap": pairs.gap("x"), "mirror": pairs.mirrored("y")},
                                   {"least": pairs.distance("x", "y", "z")}).orderBy("g").collect()
    scanned = pair_sums.pair_sums(df, ["g"], "w", {"gap": "x"}, {"mirror": "y"}).join(
        pair_sums.closest_pairs(df, ["g"], ["x", "y", "z"], "least"), "g").orderBy("g").collect()
    for a, b in zip(fold, scanned, strict=True):
        assert a["g"] == b["g"]
        assert [b[c] for c in ("gap", "mirror", "least")] == pytest.approx([a[c] for c in ("gap", "mirror", "least")], abs=1e-9)


def test_one_large_group_is_cut_and_its_closest_pair_found(spark, monkeypatch):
    monkeypatch.setattr(scan, "TASK_ROWS", 20_000)
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("g"), (F.col("id") % n).cast("double").alias("x"),
                               ((F.col("id") * 7919) % n).cast("double").alias("y"), F.lit(1.0).alias("w"))
    got = pair_sums.pair_sums(df, ["g"], "w", {"gap": "x"}, {"mirror": "y"}).first()
    assert got["gap"] == pytest.approx((n ** 3 - n) / 6, rel=1e-12)
    assert got["mirror"] == pytest.approx((n - 1) * (n * (n - 1) / 2), rel=1e-12)
    ids = np.arange(n)
    lattice = min(np.hypot(k, min(k * 7919 % n, n - k * 7919 % n)) for k in range(1, 1_000))
    least = pair_sums.closest_pairs(df, ["g"], ["x", "y"], "least").first()["least"]
    assert least == pytest.approx(lattice) and len(ids) == n


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pair_sums.pair_sums(df, ["g"], "w", {"gap": "x"}).count() == 0
    assert pair_sums.closest_pairs(df, ["g"], ["x", "y"], "least").count() == 0


def test_few_points_ask_neighbouring_cells(spark):
    """A point asks only cells within the bound: of 26 neighbours about (1 + 2 / WIDE)^3 - 1."""
    places = spark.range(20_000).selectExpr(*[f"1000 * rand({i}) AS {c}_place" for i, c in enumerate("xyz")])
    reached = places.select(sum(
        (F.when(pair_sums._reaches("x", F.lit(i)) & pair_sums._reaches("y", F.lit(j)) & pair_sums._reaches("z", F.lit(k)), 1)
         .otherwise(0) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)), F.lit(0)).alias("n"))
    assert 1 < reached.agg(F.avg("n")).first()[0] < 6


def test_pairs_across_borders_of_wide_cells_are_found(spark):
    """Two points as near as the bound, at every place relative to the borders of cells."""
    pairs = [(g, float(x), 0.0) for g in range(60) for x in (0, 100, 40 + g / 7, 41 + g / 7)]
    least = pair_sums.closest_pairs(spark.createDataFrame(pairs, "g long, x double, y double"), ["g"], ["x", "y"], "least")
    assert {round(r["least"], 9) for r in least.collect()} == {1.0}
