"""Relief run prevention: runs and inherited situations, in relief appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators import states as G
from moundworks.operators.metrics import join_lookup, known, total, z_score

XWOBA = "estimated_woba_using_speedangle"
NEEDED = [*S.PITCH_KEY, "game_year", "inning", "inning_topbot", "outs_when_up", "on_1b", "on_2b",
          "on_3b", "home_score", "away_score", "bat_score", "fld_score", XWOBA]
ENTRY_STATE = ["inning", "is_top", "score_diff", "outs_when_up", "base_state"]


def appearances(states_with_runs: DataFrame) -> DataFrame:
    """One row per pitcher and game: entry state, pitches, runs, contact value, first inning.

    The only step over pitches; everything later works on appearances. The entry state is, per
    column, the first known value by pitch number and then at bat. Both fit one long, which keeps
    the aggregation hash based.
    """
    at = F.shiftleft(F.col("pitch_number").cast("long"), 32) + F.col("at_bat_number")

    def first_known(column: str) -> Column:
        return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), at)).alias(column)

    rows = states_with_runs.where(known("game_pk", "pitcher")).groupBy("game_pk", "pitcher").agg(
        *[first_known(c) for c in ("game_year", *ENTRY_STATE)],
        total("runs_scored").alias("actual_runs"),
        F.count(F.lit(1)).alias("pitches"),
        F.count(XWOBA).alias("valued_pitches"),
        total(XWOBA).alias("xwoba_sum"),
        F.max(P.flag(F.col("inning") == 1)).alias("started"))
    return rows.withColumn("appearance_id", P.composite_key("game_pk", "pitcher"))


def appearance_usage(games: DataFrame) -> DataFrame:
    """Games, games with a first-inning pitch and their share per pitcher-season."""
    return games.where(known(*S.SEASON_KEY)).groupBy(*S.SEASON_KEY).agg(
        F.count("game_pk").alias("total_appearances"),
        F.sum("started").alias("games_started"),
    ).withColumn("start_pct", F.col("games_started").cast("double") / F.col("total_appearances"))


def games_pitched(pitches: DataFrame) -> DataFrame:
    """Distinct games per pitcher-season, flagged when they include a first-inning pitch."""
    return pitches.where(known(*S.SEASON_KEY, "game_pk")).groupBy(*S.SEASON_KEY, "game_pk").agg(
        F.max(P.flag(F.col("inning") == 1)).alias("started"))


def relievers(games: DataFrame, max_start_share: float = S.RELIEVER_START_SHARE) -> DataFrame:
    usage = appearance_usage(games)
    return usage.where(F.col("start_pct") < max_start_share)


def relief_pitches(pitches: DataFrame) -> DataFrame:
    """The pitches of relievers."""
    keep = relievers(games_pitched(pitches)).select(*S.SEASON_KEY)
    return join_lookup(pitches, keep, S.SEASON_KEY, "left_semi")


def relief_appearances(all_appearances: DataFrame) -> DataFrame:
    return all_appearances.join(
        relievers(all_appearances).select(*S.SEASON_KEY), S.SEASON_KEY, "left_semi")


def inherited_value(entries: DataFrame, run_table: DataFrame, win_table: DataFrame) -> DataFrame:
    """Expected minus allowed runs, weighted by how open the game was on entry."""
    runs = run_table.select("outs_when_up", "base_state", F.col("run_expectancy").alias("re_at_entry"))
    wins = win_table.select(*S.STATE_KEY, F.col("win_prob").alias("wp_at_entry"))
    entered = join_lookup(
        join_lookup(entries, runs, ["outs_when_up", "base_state"]), wins, S.STATE_KEY)
    opened = entered.withColumn("openness", F.abs(F.col("wp_at_entry") - 0.5))
    mean = opened.agg(F.avg("openness").alias("m")).scalar()
    return opened.withColumns({
        "leverage_index": F.try_divide(F.col("openness"), mean),
        "inherited_value": F.col("re_at_entry") - F.col("actual_runs"),
    }).withColumn("leveraged_inherited_value",
                  F.col("inherited_value") * F.col("leverage_index")).drop("openness")


def relief_run_prevention(all_appearances: DataFrame, run_table: DataFrame, win_table: DataFrame,
                          min_pitches: int = S.RELIEF_MIN_PITCHES) -> DataFrame:
    """RRP+ per reliever season; scored over all relievers, then cut to the larger samples."""
    valued = inherited_value(relief_appearances(all_appearances), run_table, win_table)
    league = valued.agg(
        F.try_divide(F.sum("xwoba_sum"), F.sum("valued_pitches").cast("double")).alias("m")).scalar()
    # summing mean - x over pitches equals n * mean - sum(x)
    saved = G.run_value_residual(F.col("xwoba_sum"), F.col("valued_pitches") * league)
    seasons = valued.groupBy(*S.SEASON_KEY).agg(
        F.sum("xwoba_sum").alias("xwoba_sum"), F.sum("valued_pitches").alias("valued_pitches"),
        F.sum("pitches").alias("relief_pitches"),
        total("leveraged_inherited_value").alias("inherited_value"),
        F.count("appearance_id").alias("relief_apps"))
    summed = seasons.withColumn(
        "pitch_rv_value", F.when(F.col("valued_pitches") > 0, saved).otherwise(0.0)
    ).withColumn("total_relief_value", F.col("pitch_rv_value") + F.col("inherited_value"))
    scored = z_score(summed, {"z_score": "total_relief_value"}).withColumn(
        "RRP_plus", 100 + 10 * F.col("z_score"))
    return scored.where(F.col("relief_pitches") >= min_pitches).select(
        *S.SEASON_KEY, "pitch_rv_value", "relief_pitches", "inherited_value", "relief_apps",
        "total_relief_value", "z_score", "RRP_plus")
