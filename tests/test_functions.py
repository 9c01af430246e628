import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.functions import text as X
from moundworks.plans import raw


@pytest.mark.parametrize("spelling, value", [
    (" 12 ", 12.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("-3", -3.0), ("+7.25", 7.25),
    ("12d", None), ("inf", None), ("nan", None), ("7%", None), ("1,000", None), ("--", None),
    ("", None), (None, None)])
def test_to_number(spark, spelling, value):
    df = spark.createDataFrame([(spelling,)], "x string")
    assert X.coerce_numeric(df, ["x", "absent"]).first()["x"] == value


@pytest.mark.parametrize("first, last, name", [
    ("  Ada ", "Byron  ", "Ada Byron"), (None, "Byron", "Byron"), ("Ada", None, "Ada"),
    (None, None, ""), ("\tAda\n", " Byron", "Ada Byron"), ("De  La", "Cruz", "De  La Cruz")])
def test_full_name(spark, first, last, name):
    df = spark.createDataFrame([(first, last)], "f string, l string")
    assert df.select(X.full_name(F.col("f"), F.col("l"))).first()[0] == name


def test_nan_becomes_null(spark):
    df = X.nan_to_null(spark.createDataFrame([(math.nan, 1), (2.0, 2)], "x double, n int"))
    assert [r["x"] for r in df.orderBy("n").collect()] == [None, 2.0]


def test_outcome_flags(spark):
    rows = [("foul_tip", 95.0, 26.0), ("swinging_strike", None, None), ("called_strike", 98.0, 30.0),
            (None, 94.9, 28.0), ("ball", 98.0, 30.1)]
    df = spark.createDataFrame(rows, "description string, launch_speed double, launch_angle double")
    got = [tuple(r)[3:] for r in df.withColumns(P.outcome_flags()).collect()]
    assert got == [(0, 1, 0, 1, 0), (1, 1, 0, 0, 0), (0, 0, 1, 1, 1), (0, 0, 0, 0, 0), (0, 0, 0, 1, 0)]


def test_game_state_expressions(spark):
    df = spark.createDataFrame(
        [(5, None, 9, "Top"), (None, 7, None, "Bot"), (None, None, None, None)],
        "on_1b long, on_2b long, on_3b long, inning_topbot string")
    got = df.select(P.base_state(), P.is_top()).collect()
    assert [tuple(r) for r in got] == [(5, 1), (2, 0), (0, 0)]
    wins = spark.createDataFrame([(1, 3, 2), (1, 2, 3), (0, 2, 3), (0, 3, 3)], "t int, h int, a int")
    assert [r[0] for r in wins.select(P.fielding_win(F.col("t"), F.col("h"), F.col("a"))).collect()] \
        == [1, 0, 1, 0]


def test_composite_key_is_null_with_a_null_part(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a long, b long")
    assert [r[0] for r in df.select(P.composite_key("a", "b")).collect()] == ["1_2", None]


def test_approach_angle_survives_zero_velocity(spark):
    df = spark.createDataFrame([(50.0, 0.0)], "release_pos_y double, vy0 double")
    assert df.select(P.time_to_plate()).first()[0] is None


def test_season_stats(spark):
    rows = [("2024", "10", "2.0", "4.0"), ("2024", "30", "4.0", "2.0"), ("2024", "x", "9.0", "9.0"),
            ("2024", "20", "0.0", "3.0"), ("2024", "20", "n/a", "3.0")]
    df = spark.createDataFrame(rows, "Season string, IP string, ERA string, FIP string").withColumn(
        "Season", F.col("Season").cast("int"))
    got = raw.season_stats(df).collect()
    league = (2.0 * 10 + 4.0 * 30 + 0.0 * 20) / 80  # unknown ERA stays in the denominator
    assert got[0]["league_ERA"] == pytest.approx(league)
    plus = {(r["innings_pitched"], r["ERA"]): r["ERA_plus"] for r in got}
    assert plus[(10.0, 2.0)] == pytest.approx(100 * league / 2)
    assert plus[(20.0, 0.0)] is None and plus[(20.0, None)] is None


def test_player_map_keeps_latest_and_folds_null_ids(spark):
    rows = [(1, 11, "b", "z", "A", "B", 2000, 2010), (1, 12, "b", "y", "A", "B", 2000, 2012),
            (1, 13, "b", "x", "A", "B", 2000, 2012), (1, 14, "b", "a", "A", "B", 2000, None),
            (None, 15, "b", "k", "N", "", 1990, 1991), (None, 16, "b", "j", "N", "", 1990, 1999),
            (2, 17, "b", "q", None, "Solo", None, None)]
    df = spark.createDataFrame(rows, S.PLAYER_REGISTER.fieldNames())
    got = {r["key_mlbam"]: r["key_fangraphs"] for r in raw.player_map(df).collect()}
    assert got == {1: 13, None: 16, 2: 17}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="zone"):
        S.require_columns(spark.range(1), ["id", "zone"], "pitches")


def test_season_is_taken_from_the_date(spark):
    df = spark.createDataFrame([(dt.date(2023, 4, 1),)], "d date")
    assert df.select(P.season_of(F.col("d"))).first()[0] == 2023
