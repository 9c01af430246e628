"""Clutch: value and win probability in the moments that move it most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.operators import states as G
from moundworks.operators.metrics import known, plus_score, total, z_score
from moundworks.operators.quantile import exact_quantile

XWOBA = "estimated_woba_using_speedangle"
NEEDED = [*S.PITCH_KEY, "game_year", "game_date", "inning", "inning_topbot", "outs_when_up",
          "on_1b", "on_2b", "on_3b", "home_score", "away_score", "bat_score", "fld_score", XWOBA]


def pitch_values(pitches: DataFrame, win_table: DataFrame | None = None) -> DataFrame:
    """Win probability added and run value residual of every pitch."""
    narrow = G.game_state(pitches.select(*NEEDED))
    table = G.win_expectancy(narrow) if win_table is None else win_table
    valued = G.win_probability_added(G.runs_over_table(narrow), table)
    league = pitches.agg(F.avg(XWOBA).alias("league")).scalar()
    return valued.select(
        *S.PITCH_KEY, "game_year", "runs_scored", "wp_before", "wp_after", "actual_wpa",
        F.abs("actual_wpa").alias("leverage_index"),
        G.run_value_residual(F.col(XWOBA), league).alias("rv_residual"))


def high_leverage(values: DataFrame, quantile: float = S.LEVERAGE_QUANTILE) -> DataFrame:
    """Pitches whose leverage reaches the quantile; an unknown leverage never does."""
    cutoff = exact_quantile(values, "leverage_index", quantile)
    return values.where(F.col("leverage_index") >= F.lit(cutoff).cast("double"))


def clutch(values: DataFrame, quantile: float = S.LEVERAGE_QUANTILE) -> DataFrame:
    """Clutch_Score per pitcher-season from the pitch values."""
    sums = high_leverage(values, quantile).where(known(*S.SEASON_KEY)).groupBy(*S.SEASON_KEY).agg(
        total("rv_residual").alias("hl_rv_residual"), total("actual_wpa").alias("hl_wpa"),
        F.count("pitcher").alias("hl_events"))
    scored = z_score(sums, {"rv_z": "hl_rv_residual", "wpa_z": "hl_wpa"})
    return plus_score(scored.withColumn("Clutch_raw", F.col("rv_z") + F.col("wpa_z")),
                      {"Clutch_Score": "Clutch_raw"})
