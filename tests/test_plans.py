"""Whole plans: invariants of the scores, hot keys, sinks and the shape of physical plans."""

import re

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from moundworks import fixtures
from moundworks import schema as S
from moundworks.operators import states as G
from moundworks.plans import nastiness, pitch_level, raw, relief, stuff
from moundworks.sources import readers, writers


@pytest.fixture(scope="module")
def models(spark):
    return fixtures.models(spark, SMALL)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_pitch_key_is_unique(models):
    assert models.pitches().select("pitch_pk").distinct().count() == models.pitches().count() == 6000


def test_hot_order_gets_the_same_pitch_numbers(spark, models, tmp_path):
    """A third of all lines in one order: numbering splits it, the result does not change."""
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    hot = lines.withColumn("l_orderkey", F.when(F.col("l_suppkey") % 3 == 0, 77).otherwise(F.col("l_orderkey")))
    hot.write.parquet(f"{tmp_path}/lineitem.parquet")
    split = fixtures.raw_pitches(spark, str(tmp_path), task_rows=200).select(*S.PITCH_KEY, "zone")
    plain = fixtures.raw_pitches(spark, str(tmp_path)).select(*S.PITCH_KEY, "zone")
    assert split.count() == plain.count() == 6000
    assert split.exceptAll(plain).isEmpty()


def test_usage_shares_sum_to_one(models):
    sums = pitch_level.usage_profile(models.pitches()).groupBy("pitcher", "season").agg(
        F.sum("usage_rate").alias("s")).toPandas()["s"]
    np.testing.assert_allclose(sums, 1)


def test_features_partition():
    assert set(S.VELOCITY_FEATURES) | set(S.SHAPE_FEATURES) == set(S.STUFF_FEATURES)
    assert len(S.STUFF_FEATURES) == 21 and len(S.SHAPE_FEATURES) == 18


def test_last_pitch_of_an_inning_leaves_no_runs(models):
    last = G.runs_remaining(models.game_states()).groupBy("game_pk", "inning").agg(
        F.max_by("runs_remaining", F.struct(*S.PITCH_ORDER)).alias("r"))
    assert last.where("r <> 0").isEmpty()


def test_relief_scores_are_centred_before_the_sample_cut(models):
    scores = relief.relief_run_prevention(
        models.appearances(), models.run_table(), models.win_table(), min_pitches=0)
    assert scores.agg(F.avg("RRP_plus")).first()[0] == pytest.approx(100)


def test_entry_state_takes_the_first_known_value_per_column(spark):
    rows = [(1, 9, 2, 1, None, 3), (1, 9, 5, 1, 4, None), (1, 9, 5, 2, 6, 7)]
    df = spark.createDataFrame(rows, "game_pk long, pitcher long, at_bat_number long, pitch_number long, "
                               "inning long, outs_when_up long")
    df = df.withColumns({c: F.lit(0) for c in ("is_top", "score_diff", "base_state", "runs_scored",
                                               "game_year")}).withColumn(relief.XWOBA, F.lit(None).cast("double"))
    got = relief.appearances(df).first()
    assert (got["inning"], got["outs_when_up"], got["pitches"], got["xwoba_sum"]) == (4, 3, 3, 0.0)


def test_event_without_contact_value_has_no_weight(models):
    target = stuff.with_target(stuff.own_features(stuff.eligible_pitches(models.pitches())))
    called = target.where("description = 'called_strike'")
    assert not called.isEmpty() and called.where("target IS NOT NULL").isEmpty()


def test_nastiness_fits_all_pitches_and_scores_good_ones(models):
    scored = nastiness.nastiness_plus(models.pitches()).toPandas()
    pdf = nastiness.features(models.pitches()).toPandas()
    x = pdf[S.NASTINESS_FEATURES].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    pdf["norm"] = np.linalg.norm(z @ axes[:3].T, axis=1)
    good = pdf[pdf.is_good_outcome == 1].set_index("pitch_pk")["norm"]
    np.testing.assert_allclose(scored.set_index("pitch_pk")["nastiness_raw"].loc[good.index], good, rtol=1e-8)
    assert scored["Nastiness_plus"].mean() == pytest.approx(100)
    assert scored["Nastiness_plus"].std(ddof=1) == pytest.approx(10)
    top = nastiness.nastiest(nastiness.nastiness_plus(models.pitches()), limit=7).toPandas()
    expected = scored[scored.game_year == 2025].nlargest(7, "Nastiness_plus")["Nastiness_plus"]
    np.testing.assert_allclose(top["Nastiness_plus"], expected)


def test_lower_thresholds_give_model_scores_on_small_data(models):
    scores = stuff.stuff_plus(
        stuff.predictions(models.stuff_matrix(), trees=5, depth=3, min_leaf=10)).toPandas()
    assert len(scores) > 20
    for kind in ("stuff", "shape", "velo"):
        for _, group in scores.groupby("pitch_type"):
            if group[f"{kind}_value"].std() > 1e-9:
                plus = group[f"{kind.title()}_plus"]
                assert plus.mean() == pytest.approx(100) and plus.std() == pytest.approx(10)


def test_grade_agrees_with_the_join_of_its_parts(models):
    p = models.pitches()
    parts = [f(p, 1) for f in (pitch_level.whiff_plus, pitch_level.contact_plus, pitch_level.chase_plus,
                               pitch_level.strike_plus, pitch_level.ball_plus)]
    joined = pitch_level.grade_of_tables(*parts).toPandas()
    fused = pitch_level.pitch_grade(p, 1, 1).toPandas()
    key = S.ARSENAL_KEY
    joined, fused = (d.sort_values(key, ignore_index=True)[sorted(d)] for d in (joined, fused))
    assert len(fused) > 100
    pd.testing.assert_frame_equal(joined, fused, check_dtype=False)


def test_scan_is_pruned_and_pushed_down(models):
    plan = executed(pitch_level.chase_plus(models.pitches()).where("game_year = 2025"))
    read = re.search(r"ReadSchema: struct<(.*?)>", plan)[1]
    assert len(read.split(",")) <= 6 and "GreaterThan(zone,9)" in plan


def test_season_filter_skips_partitions(models):
    plan = executed(readers.between(models.pitches(), "game_year", 2025, 2025).select("pitch_pk"))
    assert re.search(r"PartitionFilters: \[[^\]]*2025", plan)


def test_read_and_write_round_trip(spark, models, tmp_path):
    raw_rows = models.pitches().select(*S.RAW_PITCHES.fieldNames())
    writers.write_table(raw_rows, f"{tmp_path}/raw", ["game_year"])
    span = readers.read_pitches(spark, f"{tmp_path}/raw", "2025-01-01", "2025-12-31")
    assert span.count() == models.pitches().where("game_year = 2025").count()
    with pytest.raises(AnalysisException):
        writers.write_table(raw_rows, f"{tmp_path}/raw", fail_if_exists=True)

    register = fixtures.player_register(spark, SMALL)
    register.write.option("header", True).csv(f"{tmp_path}/register.csv")
    again = readers.read_player_register(spark, f"{tmp_path}/register.csv")
    assert raw.player_map(again).count() == models.players().count()

    lines = fixtures.season_lines(spark, SMALL)
    lines.write.parquet(f"{tmp_path}/seasons")
    assert readers.read_season_stats(spark, f"{tmp_path}/seasons", 2025, 2025).count() * 2 == lines.count()


def test_csv_export_keeps_order(models, tmp_path):
    profile = pitch_level.usage_profile(models.pitches())
    writers.export_csv(profile, f"{tmp_path}/all", pitch_level.pitch_level_order())
    parts = [pd.read_csv(f) for f in sorted(tmp_path.glob("all/part-*.csv"))]
    got = pd.concat(parts, ignore_index=True)
    expected = got.sort_values(["pitcher", "season", "usage_rate"], ascending=[True, False, False],
                               ignore_index=True)
    pd.testing.assert_frame_equal(got[["pitcher", "season", "usage_rate"]],
                                  expected[["pitcher", "season", "usage_rate"]])
    writers.export_csv(profile, f"{tmp_path}/top", [F.col("usage_rate").desc()], limit=3)
    assert [len(pd.read_csv(f)) for f in tmp_path.glob("top/part-*.csv")] == [3]


def test_views(spark, models):
    models.register_views()
    assert spark.sql("SELECT count(*) FROM raw_statcast").first()[0] == 6000
