"""Everything known about each pitcher-season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.plans.pitch_level import season_counts

# The published columns, in order.
COLUMNS = [
    "pitcher", "full_name", "season", "WAR", "innings_pitched", "pitches_thrown", "whiffs",
    "swings", "csw_rate", "called_strikes", "strikeouts", "K_percent", "K/9", "walks",
    "BB_percent", "BB/9", "hard_hits", "barrels", "home_runs", "H/9", "GB/FB", "BA_allowed",
    "WHIP", "ERA", "ERA_plus", "FIP", "FIP_plus", "SIERA", "run_value", "win_probability_added",
    "Clutch_Score", "ArsenalK_plus", "ArsenalDesign_plus", "relief_apps", "total_relief_value",
    "RRP_plus",
]


def order() -> list[Column]:
    return [F.col("pitcher").asc(), F.col("season").desc(), F.col("innings_pitched").desc(),
            F.col("pitches_thrown").desc()]


def pitcher_level_model(pitches: DataFrame, players: DataFrame, seasons: DataFrame,
                        clutch: DataFrame, relief: DataFrame,
                        arsenal: DataFrame | None) -> DataFrame:
    """Season counts joined to season lines and scores; starters have no relief columns.

    Without ``arsenal`` (the model outputs) its two columns are left out.
    """
    key = ["pitcher", "season"]

    def by_season(df: DataFrame, **renames: str) -> DataFrame:
        return df.withColumnRenamed("game_year", "season").withColumnsRenamed(renames)

    ids = players.select(F.col("key_mlbam").alias("pitcher"), "full_name",
                         F.col("key_fangraphs").alias("IDfg"))
    lines = by_season(seasons, AVG="BA_allowed")
    clutches = by_season(clutch, rv_z="run_value", wpa_z="win_probability_added").select(
        *key, "run_value", "win_probability_added", "Clutch_Score")
    reliefs = by_season(relief).select(*key, "relief_apps", "total_relief_value", "RRP_plus")

    joined = season_counts(pitches).join(ids, "pitcher", "inner").join(
        lines, ["IDfg", "season"], "inner").join(clutches, key, "inner")
    if arsenal is not None:
        joined = joined.join(by_season(arsenal), key, "inner")
    joined = joined.join(reliefs, key, "left")
    return joined.select(*[f"`{c}`" for c in COLUMNS if c in joined.columns])
