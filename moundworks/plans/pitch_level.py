"""Scores per pitcher, season and pitch type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators.metrics import (
    combine_metrics, known, mean_metric, plus_score, rate_metric, weighted_score)

KEY = S.ARSENAL_KEY
LEAGUE = ["game_year", "pitch_type"]
XWOBA = "estimated_woba_using_speedangle"


def _seasonal(pitches: DataFrame, *columns: str) -> DataFrame:
    """Typed pitches with the season taken from the date and only the columns a metric needs."""
    return pitches.where(known("pitch_type")).select(
        "pitcher", P.season_of(F.col("game_date")).alias("game_year"), "pitch_type", *columns)


def whiff_plus(pitches: DataFrame, min_swings: int = 20) -> DataFrame:
    swings = _seasonal(pitches, "swing_flag", "whiff_flag").where(F.col("swing_flag") == 1)
    rates = rate_metric(swings, KEY, count=("swings", F.col("swing_flag")),
                        hits=("whiffs", F.col("whiff_flag")), rate="whiff_rate", min_count=min_swings)
    return plus_score(rates, {"Whiff_plus": "whiff_rate"}, LEAGUE)


def contact_plus(pitches: DataFrame, min_contacts: int = 10) -> DataFrame:
    """Lower contact value is better; contacts without a value count for the threshold."""
    contacts = _seasonal(pitches, "description", XWOBA).where(
        F.col("description").isin(S.IN_PLAY_EVENTS))
    means = mean_metric(contacts, KEY, value=XWOBA, count="contacts", mean="contact_woba",
                        min_count=min_contacts)
    return plus_score(means, {"Contact_plus": "contact_woba"}, LEAGUE, invert={"Contact_plus"})


def strike_plus(pitches: DataFrame, min_pitches: int = 10) -> DataFrame:
    rates = rate_metric(_seasonal(pitches, "description"), KEY,
                        count=("pitches", F.col("description")),
                        hits=("strikes", P.happened(S.STRIKE_EVENTS)),
                        rate="strike_rate", min_count=min_pitches)
    return plus_score(rates, {"Strike_plus": "strike_rate"}, LEAGUE)


def ball_plus(pitches: DataFrame, min_pitches: int = 10) -> DataFrame:
    rates = rate_metric(_seasonal(pitches, "description"), KEY,
                        count=("pitches", F.col("description")),
                        hits=("balls", P.happened(S.BALL_EVENTS)),
                        rate="ball_rate", min_count=min_pitches)
    return plus_score(rates, {"Ball_plus": "ball_rate"}, LEAGUE, invert={"Ball_plus"})


def chase_plus(pitches: DataFrame, min_outside: int = 10) -> DataFrame:
    outside = _seasonal(pitches, "zone", "swing_flag").where(F.col("zone") > 9)
    rates = rate_metric(outside, KEY, count=("pitches_outside", F.col("zone")),
                        hits=("chases", F.col("swing_flag")), rate="chase_rate",
                        min_count=min_outside)
    return plus_score(rates, {"Chase_plus": "chase_rate"}, LEAGUE)


def _graded(scores: DataFrame) -> DataFrame:
    weighed = scores.select(*KEY, *S.GRADE_WEIGHTS).withColumn(
        "pitch_score", weighted_score(S.GRADE_WEIGHTS))
    return plus_score(weighed, {"PitchGrade_plus": "pitch_score"}, LEAGUE)


def grade_of_tables(*metric_tables: DataFrame) -> DataFrame:
    """PitchGrade+ from five stored metric tables."""
    narrow = [t.select(*KEY, next(c for c in t.columns if c.endswith("_plus")))
              for t in metric_tables]
    return _graded(combine_metrics(narrow, KEY))


def pitch_grade(pitches: DataFrame, min_swings: int = 20, min_rows: int = 10) -> DataFrame:
    """PitchGrade+ straight from the pitches.

    All five metrics share one scan and one shuffle: each is a conditional aggregate, NULL below
    its own sample threshold, so it takes part in its own league mean only where it qualifies.
    """
    described = F.col("description")
    swing, outside = F.col("swing_flag") == 1, F.col("zone") > 9
    contact = described.isin(S.IN_PLAY_EVENTS)

    def count_of(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = _seasonal(pitches, "description", "zone", "swing_flag", "whiff_flag", XWOBA).where(
        known(*KEY)).groupBy(*KEY).agg(
            count_of(swing).alias("swings"),
            F.sum(F.when(swing, F.col("whiff_flag"))).alias("whiffs"),
            count_of(contact).alias("contacts"),
            F.avg(F.when(contact, F.col(XWOBA))).alias("contact_woba"),
            F.count(described).alias("pitches"),
            F.sum(P.happened(S.STRIKE_EVENTS)).alias("strikes"),
            F.sum(P.happened(S.BALL_EVENTS)).alias("balls"),
            count_of(outside).alias("pitches_outside"),
            F.sum(F.when(outside, F.col("swing_flag"))).alias("chases"))

    def qualified(hits: str, n: str, least: int) -> Column:
        return F.when(F.col(n) >= least, F.col(hits).cast("double") / F.col(n).cast("double"))

    rates = counts.select(
        *KEY,
        qualified("whiffs", "swings", min_swings).alias("whiff_rate"),
        F.when(F.col("contacts") >= min_rows, F.col("contact_woba")).alias("contact_woba"),
        qualified("chases", "pitches_outside", min_rows).alias("chase_rate"),
        qualified("strikes", "pitches", min_rows).alias("strike_rate"),
        qualified("balls", "pitches", min_rows).alias("ball_rate"))
    scores = plus_score(
        rates,
        {"Whiff_plus": "whiff_rate", "Contact_plus": "contact_woba", "Chase_plus": "chase_rate",
         "Strike_plus": "strike_rate", "Ball_plus": "ball_rate"},
        LEAGUE, invert={"Contact_plus", "Ball_plus"})
    return _graded(scores.where(known(*S.GRADE_WEIGHTS)))


def pitch_gap(stuff: DataFrame, grade: DataFrame) -> DataFrame:
    """Stuff+ minus PitchGrade+: results better or worse than the pitch's properties."""
    return stuff.select(*KEY, "Stuff_plus").join(
        grade.select(*KEY, "PitchGrade_plus"), KEY, "inner"
    ).withColumn("PitchGap", F.col("Stuff_plus") - F.col("PitchGrade_plus"))


def _outcome_counts() -> list[Column]:
    n = F.count(F.lit(1)).cast("double")
    return [
        F.count(F.lit(1)).alias("pitches_thrown"),
        F.sum("whiff_flag").alias("whiffs"),
        F.sum("swing_flag").alias("swings"),
        ((F.sum("whiff_flag") + F.sum("called_strike_flag")).cast("double") / n).alias("csw_rate"),
        F.sum("called_strike_flag").alias("called_strikes"),
        F.sum("hard_hit_flag").alias("hard_hits"),
        F.sum("barrel_flag").alias("barrels"),
    ]


# Published column names.
PROFILE_MEANS = {
    "release_speed": "release_speed", "release_pos_x": "release_pos_x",
    "release_pos_y": "release_pos_y", "release_extension": "release_extension",
    "arm_angle": "arm_angle", "release_spin_rate": "release_spin_rate",
    "horizontal_break": "pfx_x", "vertical_break": "pfx_z", "spin_axis": "spin_axis",
    "halfway_velo_x": "vx0", "halfway_velo_y": "vy0", "halfway_velo_z": "vz0",
    "halfway_accel_x": "ax", "halfway_accel_y": "ay", "halfway_accel_z": "az",
    "gravity_break": "api_break_z_with_gravity", "arm_side_break": "api_break_x_arm",
    "inside_batter_break": "api_break_x_batter_in",
}


def usage_profile(pitches: DataFrame) -> DataFrame:
    """Averages and counts per pitch type with its share of the pitcher's season.

    The share's denominator counts untyped pitches too. The window runs over the aggregate, where
    a pitcher-season has one row per pitch type.
    """
    by_type = pitches.groupBy("pitcher", F.col("game_year").alias("season"), "pitch_type").agg(
        *_outcome_counts(), *[F.avg(c).alias(out) for out, c in PROFILE_MEANS.items()])
    thrown = F.col("pitches_thrown").cast("double")
    season = W.partitionBy("pitcher", "season")
    return by_type.withColumn("usage_rate", thrown / F.sum(thrown).over(season))


def season_counts(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy("pitcher", F.col("game_year").alias("season")).agg(*_outcome_counts())


# The published columns, in order.
PITCH_LEVEL_COLUMNS = [
    "pitcher", "full_name", "season", "pitch_type", "pitches_thrown", "usage_rate",
    "release_speed", "release_pos_x", "release_pos_y", "release_extension", "arm_angle",
    "release_spin_rate", "horizontal_break", "vertical_break", "spin_axis", "whiffs", "swings",
    "csw_rate", "called_strikes", "hard_hits", "barrels",
    "whiff_plus", "Contact_plus", "Chase_plus", "Strike_plus", "Ball_plus", "Pitch_score",
    "PitchGrade_plus", "velo_plus", "shape_plus", "stuff_plus", "PitchGap",
]


def graded_profile(pitches: DataFrame, grade: DataFrame, players: DataFrame) -> DataFrame:
    """Usage profile with pitch grade and player name."""
    grades = grade.withColumnsRenamed(
        {"game_year": "season", "Whiff_plus": "whiff_plus", "pitch_score": "Pitch_score"})
    names = players.select(F.col("key_mlbam").alias("pitcher"), "full_name")
    return usage_profile(pitches).join(grades, ["pitcher", "season", "pitch_type"], "inner").join(
        names, "pitcher", "inner")


def pitch_level_order() -> list[Column]:
    return [F.col("pitcher").asc(), F.col("season").desc(), F.col("usage_rate").desc()]


def pitch_level_model(pitches: DataFrame, grade: DataFrame, stuff: DataFrame, gap: DataFrame,
                      players: DataFrame) -> DataFrame:
    """Everything known about each pitch of each pitcher-season; the sink orders it."""
    key = ["pitcher", "season", "pitch_type"]
    stuff_scores = stuff.select(
        "pitcher", F.col("game_year").alias("season"), "pitch_type",
        F.col("Velo_plus").alias("velo_plus"), F.col("Shape_plus").alias("shape_plus"),
        F.col("Stuff_plus").alias("stuff_plus"))
    gaps = gap.select("pitcher", F.col("game_year").alias("season"), "pitch_type", "PitchGap")
    return (graded_profile(pitches, grade, players)
            .join(stuff_scores, key, "inner").join(gaps, key, "inner")
            .select(*PITCH_LEVEL_COLUMNS))
