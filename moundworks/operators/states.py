"""Game states, expectancy tables and win probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators.metrics import known
from moundworks.operators.scan import ordered_delta, sum_after
from moundworks.storage import sized_lookup


def game_state(pitches: DataFrame) -> DataFrame:
    """Score from the fielding side's view, occupied bases and half inning."""
    return pitches.withColumns({
        "score_diff": F.col("fld_score") - F.col("bat_score"),
        "base_state": P.base_state(),
        "is_top": P.is_top(),
    })


def final_scores(pitches: DataFrame) -> DataFrame:
    return pitches.where(known("game_pk")).groupBy("game_pk").agg(
        F.max("home_score").alias("final_home"), F.max("away_score").alias("final_away"))


def state_expectancy(df: DataFrame, keys: list[str], target: str, *, mean: str,
                     min_samples: int = S.STATE_MIN_SAMPLES, weight: str | None = None) -> DataFrame:
    """Mean of ``target`` and sample count per state, for states seen often enough.

    ``weight`` names a row count when ``df`` is pre-aggregated.
    """
    n = F.count(target) if weight is None else F.sum(weight)
    average = F.avg(target) if weight is None else F.try_divide(
        F.sum(F.col(target) * F.col(weight)).cast("double"), F.sum(weight).cast("double"))
    return (df.where(known(*keys)).groupBy(*keys)
            .agg(average.alias(mean), n.alias("samples"))
            .where(F.col("samples") >= min_samples))


def states_by_game(states: DataFrame) -> DataFrame:
    """Rows per game and state with the best score seen in it.

    Everything about winners is computed from this table, so the pitches are read once, combined
    map-side, and a game that holds a large share of them has no more rows than states.
    """
    return states.where(known("game_pk")).groupBy("game_pk", *S.STATE_KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("home_score").alias("home_score"), F.max("away_score").alias("away_score"))


def win_expectancy(states: DataFrame, min_samples: int = S.STATE_MIN_SAMPLES) -> DataFrame:
    """Share of rows in each state whose fielding side won the game."""
    # the window holds a game's distinct states, not its pitches
    game = W.partitionBy("game_pk")
    decided = states_by_game(states).withColumn("fld_win", P.fielding_win(
        F.col("is_top"), F.max("home_score").over(game), F.max("away_score").over(game)))
    return state_expectancy(decided, S.STATE_KEY, "fld_win", mean="win_prob",
                            min_samples=min_samples, weight="n")


def runs_in_game(pitches: DataFrame) -> DataFrame:
    """Change of the batting score since the pitch before, per game."""
    return ordered_delta(pitches, "bat_score", "runs_scored", S.PITCH_ORDER, ["game_pk"])


def runs_over_table(pitches: DataFrame) -> DataFrame:
    """The same over all games in date order, across their boundaries."""
    day = F.datediff("game_date", F.lit("1970-01-01").cast("date"))
    return ordered_delta(pitches.withColumn("game_day", day), "bat_score", "runs_scored",
                         ["game_day", "game_pk", *S.PITCH_ORDER]).drop("game_day")


def runs_remaining(pitches_with_runs: DataFrame) -> DataFrame:
    """Runs scored after each pitch in its inning."""
    return sum_after(pitches_with_runs, "runs_scored", "runs_remaining", S.PITCH_ORDER,
                     ["game_pk", "inning"])


def run_expectancy(states_with_runs: DataFrame, min_samples: int = S.STATE_MIN_SAMPLES) -> DataFrame:
    """Mean runs to come by outs and occupied bases."""
    narrow = states_with_runs.select(
        "game_pk", "inning", *S.PITCH_ORDER, "runs_scored", "outs_when_up", "base_state")
    return state_expectancy(runs_remaining(narrow), ["outs_when_up", "base_state"],
                            "runs_remaining", mean="run_expectancy", min_samples=min_samples)


def win_probability_added(states_with_runs: DataFrame, win_table: DataFrame) -> DataFrame:
    """Win probability after the pitch minus before; only the score changes between the two."""
    before = sized_lookup(win_table.select(*S.STATE_KEY, F.col("win_prob").alias("wp_before")))
    after = (before.withColumnRenamed("score_diff", "score_diff_after")
             .withColumnRenamed("wp_before", "wp_after"))
    after_key = ["score_diff_after" if k == "score_diff" else k for k in S.STATE_KEY]
    return (states_with_runs
            .withColumn("score_diff_after", F.col("score_diff") - F.col("runs_scored"))
            .join(before, S.STATE_KEY, "left").join(after, after_key, "left")
            .withColumn("actual_wpa", F.col("wp_after") - F.col("wp_before")))


def run_value_residual(xwoba: Column, league_mean: Column) -> Column:
    """Runs saved against the league's mean contact value."""
    return league_mean * S.RUNS_PER_WOBA - xwoba * S.RUNS_PER_WOBA
