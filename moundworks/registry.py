"""Named queries over one input folder; doubles are rounded for comparison with the SQL oracle.

They are rounded to multiples of 2^-20 and not to six decimals: averages of decimal inputs often lie
exactly between two decimals, where the last bit of a sum would decide.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks import fixtures
from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.models import Models
from moundworks.operators import factors, learn, metrics, pair_sums
from moundworks.operators import states as G
from moundworks.operators.quantile import exact_quantile
from moundworks.operators.scan import running_sum
from moundworks.plans import arsenal, nastiness, pitch_level, raw, relief, stuff
from moundworks.sources import readers, spans, writers
from moundworks.sources.readers import between
from moundworks.storage import cut_lineage

GRID = 2.0 ** 20
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame) -> DataFrame:
    return df.select([
        (F.floor(F.col(f"`{c}`") * GRID + 0.5) / GRID).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes])


def _pitch_pk() -> Column:
    return P.composite_key(*S.PITCH_KEY)


def _pitch_flags(t: Models) -> DataFrame:
    return t.pitches().select(
        "pitch_pk", "whiff_flag", "swing_flag", "called_strike_flag", "hard_hit_flag", "barrel_flag")


def _pitches_of_span(t: Models) -> DataFrame:
    """Date-bounded scan; the season bound prunes partitions of the stored table."""
    seasons = between(t.pitches(), "game_year", 2025, 2025)
    days = between(seasons, "game_date", F.lit("2025-03-01").cast("date"),
                   F.lit("2025-12-31").cast("date"))
    return days.select("pitch_pk", "pitcher", "description")


def _season_numeric(t: Models) -> DataFrame:
    return raw.season_numbers(t.season_lines()).select(
        "IDfg", "player_name", "game_year", "team", *S.SEASON_NUMERIC)


def _season_plus(t: Models) -> DataFrame:
    return t.seasons().select("IDfg", "game_year", "ERA", "FIP", "league_ERA", "league_FIP",
                              "ERA_plus", "FIP_plus")


def _grade_of_tables(t: Models) -> DataFrame:
    p = t.pitches()
    return pitch_level.grade_of_tables(*[f(p) for f in (
        pitch_level.whiff_plus, pitch_level.contact_plus, pitch_level.chase_plus,
        pitch_level.strike_plus, pitch_level.ball_plus)])


def _usage(t: Models) -> DataFrame:
    return pitch_level.usage_profile(t.pitches()).select(
        "pitcher", "season", "pitch_type", "pitches_thrown", "usage_rate", "csw_rate", "whiffs",
        "swings", "called_strikes", "hard_hits", "barrels", *pitch_level.PROFILE_MEANS)


def _own_features(t: Models) -> DataFrame:
    featured = stuff.relative_features(stuff.own_features(stuff.eligible_pitches(t.pitches())))
    return featured.select(
        "pitch_pk", "ivb", "hb", "movement_total", "movement_sq", "spin_eff_proxy", "ssw_proxy",
        "movement_ratio", "break_angle", "velo_sq", "spin_sq", "spin_diff", "release_diff")


def _baseline_diffs(t: Models) -> DataFrame:
    featured = stuff.relative_features(stuff.own_features(stuff.eligible_pitches(t.pitches())))
    return featured.select("pitch_pk", "fb_velo", "fb_ivb", "fb_hb", "velo_diff", "ivb_diff",
                           "hb_diff", "movement_diff")


def _target_parts(t: Models) -> DataFrame:
    return stuff.with_target(stuff.own_features(stuff.eligible_pitches(t.pitches())))


def _event_weights(t: Models) -> DataFrame:
    return stuff.event_weights(stuff.own_features(stuff.eligible_pitches(t.pitches())))


def _nastiness_features(t: Models) -> DataFrame:
    return nastiness.features(t.pitches()).select(
        "pitch_pk", *S.NASTINESS_FEATURES, "is_good_outcome")


def _nastiness_standardized(t: Models) -> DataFrame:
    z = learn.standardize(nastiness.features(t.pitches()), S.NASTINESS_FEATURES)
    return z.select("pitch_pk", *[f"{c}_z" for c in S.NASTINESS_FEATURES])


def _nastiest(t: Models) -> DataFrame:
    return nastiness.nastiest(t.nastiness())


def _row_counts(t: Models) -> DataFrame:
    """Rows of each ingested table and of the two filtered pitch sets."""
    sets = {"raw_statcast": t.pitches(), "player_id_map": t.players(),
            "pitcher_season_stats": t.seasons(), "stuff_events": stuff.eligible_pitches(t.pitches()),
            "nasty_outcomes": nastiness.features(t.pitches()).where("is_good_outcome = 1")}
    return reduce(DataFrame.unionByName, [writers.row_count(df, n) for n, df in sets.items()])


def _game_state(t: Models) -> DataFrame:
    return G.game_state(t.pitches()).select("pitch_pk", "score_diff", "base_state", "is_top")


def _fielding_win(t: Models) -> DataFrame:
    states = G.game_state(t.pitches())
    decided = metrics.join_lookup(states, G.final_scores(states), ["game_pk"])
    return decided.select("pitch_pk", P.fielding_win(
        F.col("is_top"), F.col("final_home"), F.col("final_away")).alias("fld_win"))


def _runs(t: Models, runs) -> DataFrame:
    return runs(t.pitches().select("pitch_pk", "game_pk", "game_date", *S.PITCH_ORDER, "bat_score")
                ).select("pitch_pk", "runs_scored")


def _inning_runs(t: Models) -> DataFrame:
    """Total, running and remaining runs of the inning at every pitch."""
    running = running_sum(t.game_states(), "runs_scored", "runs_so_far", S.PITCH_ORDER,
                          ["game_pk", "inning"])
    return G.runs_remaining(running).select(
        _pitch_pk().alias("pitch_pk"), "runs_so_far", "runs_remaining",
        (F.col("runs_so_far") + F.col("runs_remaining")).alias("total_runs"))


def _leverage_cutoff(t: Models) -> DataFrame:
    cutoff = exact_quantile(t.clutch_values(), "leverage_index", S.LEVERAGE_QUANTILE)
    return t.clutch_values().agg(
        F.count("leverage_index").alias("known"),
        F.count(F.when(F.col("leverage_index") >= F.lit(cutoff).cast("double"), 1)).alias("kept"),
        F.lit(cutoff).cast("double").alias("cutoff"))


def _entry_state(t: Models) -> DataFrame:
    entries = relief.relief_appearances(t.appearances())
    return entries.select("appearance_id", "pitcher", "game_year", *relief.ENTRY_STATE, "actual_runs")


def _inherited(t: Models) -> DataFrame:
    entries = relief.relief_appearances(t.appearances())
    return relief.inherited_value(entries, t.run_table(), t.win_table()).select(
        "appearance_id", "re_at_entry", "wp_at_entry", "leverage_index", "inherited_value",
        "leveraged_inherited_value")


def _approach_angles(t: Models) -> DataFrame:
    return arsenal.approach_angles(t.pitches()).select(
        "pitch_pk", "t_plate", "vx_plate", "vy_plate", "vz_plate", "VAA", "HAA")


def _arsenal_interactions(t: Models) -> DataFrame:
    return arsenal.interactions(t.profile(t.mean_target()))


def _interactions_by_scan(t: Models) -> DataFrame:
    """The interactions of a repertoire without folding it: for groups of any size."""
    profile = learn.standardize(cut_lineage(t.profile(t.mean_target())), arsenal.SHAPE)
    return arsenal.interactions_by_scan(profile)


def _pitch_pair_sums(t: Models) -> DataFrame:
    """All pairs of single pitches of a pitcher's season, per square of their number."""
    sums = pair_sums.pair_sums(
        t.pitches(), S.SEASON_KEY, "release_extension",
        {"velo_gap": "release_speed", "ivb_gap": "pfx_z", "hb_gap": "pfx_x"}, {"hb_mirror": "pfx_x"})
    sizes = t.pitches().groupBy(*S.SEASON_KEY).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return sums.join(sizes, S.SEASON_KEY).select(
        *S.SEASON_KEY, *[(F.col(c) / (F.col("n") * F.col("n"))).alias(c) for c in
                         ("velo_gap", "ivb_gap", "hb_gap", "hb_mirror")])


def _closest_pitches(t: Models) -> DataFrame:
    return pair_sums.closest_pairs(
        t.pitches(), S.SEASON_KEY, ["release_speed", "pfx_z", "pfx_x"], "least_distance")


def _reversed_csv(t: Models, df: DataFrame, name: str) -> str:
    """A CSV file whose columns stand in another order than the schema's."""
    path = f"{t.workspace.new_path(name)}.csv"
    df.select(*[f"`{c}`" for c in reversed(df.columns)]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _register_from_csv(t: Models) -> DataFrame:
    path = _reversed_csv(t, t.player_register(), "register")
    return raw.player_map(readers.read_player_register(t.spark, path))


def _seasons_from_csv(t: Models) -> DataFrame:
    path = _reversed_csv(t, t.season_lines(), "seasons")
    return raw.season_numbers(readers.read_season_stats(t.spark, path, 2025, 2025)).select(
        "IDfg", "player_name", "game_year", "team", *S.SEASON_NUMERIC)


def _pitches_from_files(t: Models) -> DataFrame:
    path = t.workspace.new_path("pitches")
    writers.write_table(t.raw_pitches(), path, partition_by=["game_year"])
    return readers.read_pitches(t.spark, path, "2025-03-01", "2025-12-31").select(
        _pitch_pk().alias("pitch_pk"), "pitcher", "description")


def _loaded_by_spans(t: Models) -> spans.SpanTable:
    """Pitches loaded by a season, by a span that overlaps it, and by one that is stored already."""
    pitches = t.raw_pitches()
    table = spans.SpanTable(t.spark, t.workspace.new_path("spans"), pitches.schema, "game_date")

    def source(a: date, b: date) -> DataFrame:
        return between(t.pitches(), "game_date", F.lit(a), F.lit(b))
    for first, last, refresh in ((date(2024, 1, 1), date(2024, 12, 31), False),
                                 (date(2024, 6, 1), date(2025, 6, 30), False),
                                 (date(2024, 2, 1), date(2025, 6, 15), False),
                                 (date(2025, 6, 15), date(2025, 6, 15), True)):
        table.load(source, first, last, refresh)
    return table


def _pitches_by_spans(t: Models) -> DataFrame:
    return _loaded_by_spans(t).read(date(2024, 1, 1)).select(_pitch_pk().alias("pitch_pk"), "pitcher", "description")


def _sql_over_views(t: Models) -> DataFrame:
    t.register_views()
    return t.spark.sql("""
        SELECT r.game_year, count(*) AS n_pitches, count(DISTINCT r.pitcher) AS n_pitchers,
               count(s.IDfg) AS in_season_lines
        FROM raw_statcast r LEFT JOIN player_id_map m ON r.pitcher = m.key_mlbam
             LEFT JOIN pitcher_season_stats s ON m.key_fangraphs = s.IDfg AND r.game_year = s.game_year
        GROUP BY r.game_year""")


def _create_only(t: Models) -> DataFrame:
    """A table that is created once; a second creation is refused."""
    path, lines = t.workspace.new_path("created"), t.seasons().select("IDfg", "game_year", "team")
    stored, refused = writers.write_table(lines, path, fail_if_exists=True), False
    try:
        writers.write_table(lines, path, fail_if_exists=True)
    except AnalysisException:
        refused = True
    return stored.withColumn("refused", F.lit(refused))


def _csv_round_trip(t: Models) -> DataFrame:
    """A sorted export and the places its rows have in the files."""
    path, scores = t.workspace.new_path("clutch_csv"), t.clutch().select("pitcher", "game_year", "Clutch_Score")
    writers.export_csv(scores, path, [F.col("Clutch_Score").desc(), F.col("pitcher"), F.col("game_year")])
    return readers.in_file_order(t.spark, path, scores.schema, "place")


def _interaction_weights(t: Models) -> DataFrame:
    """The interaction model of the arsenal scores, solved from triangular factors."""
    features = arsenal.arsenal_features(t.profile(t.mean_target()))
    model = factors.ridge_cv(features, S.INTERACTION_FEATURES, "base_score", S.SEASON_KEY)
    return learn.weight_report(t.spark, {"interaction": model})


def _speed_weights(t: Models) -> DataFrame:
    """Spin by release speed and extension, without a penalty."""
    model = factors.least_squares(t.pitches(), ["release_speed", "release_extension"], "release_spin_rate")
    return learn.weight_report(t.spark, {"spin": model}).withColumn("intercept", F.lit(float(model.intercept)))


def _top(df: DataFrame, score: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(score).desc(), "pitcher", "game_year").limit(n)


QUERIES: dict[str, Callable[[Models], DataFrame]] = {
    "pitch_flags": _pitch_flags,
    "pitches_of_span": _pitches_of_span,
    "season_numeric_coerced": _season_numeric,
    "league_weighted_means": lambda t: raw.league_means(
        raw.season_numbers(t.season_lines())),
    "season_era_fip_plus": _season_plus,
    "player_map_dedup": lambda t: t.players(),
    "row_counts": _row_counts,
    "register_from_csv": _register_from_csv,
    "season_numeric_from_csv": _seasons_from_csv,
    "pitches_from_files": _pitches_from_files,
    "pitches_loaded_by_spans": _pitches_by_spans,
    "loaded_spans": lambda t: _loaded_by_spans(t).manifest().select(
        "load", F.col("start").cast("string").alias("first_day"), F.col("end").cast("string").alias("last_day"), "n_rows"),
    "sql_over_views": _sql_over_views,
    "table_create_only": _create_only,
    "csv_round_trip": _csv_round_trip,
    "whiff_plus": lambda t: pitch_level.whiff_plus(t.pitches()),
    "contact_plus": lambda t: pitch_level.contact_plus(t.pitches()),
    "strike_plus": lambda t: pitch_level.strike_plus(t.pitches()),
    "ball_plus": lambda t: pitch_level.ball_plus(t.pitches()),
    "chase_plus": lambda t: pitch_level.chase_plus(t.pitches()),
    "pitch_grade_plus": lambda t: pitch_level.pitch_grade(t.pitches()),
    "pitch_grade_of_tables": _grade_of_tables,
    "score_distribution": lambda t: writers.distribution(
        pitch_level.strike_plus(t.pitches()), "Strike_plus"),
    "pitch_profile_usage": _usage,
    "pitch_level_graded_profile": lambda t: pitch_level.graded_profile(
        t.pitches(), t.grade(), t.players()),
    "pitch_physics_features": _own_features,
    "fastball_baseline_diffs": _baseline_diffs,
    "event_weight_fill": _event_weights,
    "stuff_target": lambda t: _target_parts(t).select(
        "pitch_pk", "is_whiff", "weak_contact", "contact_value", "target"),
    "feature_means": lambda t: learn.column_means(t.training_rows(), S.STUFF_FEATURES),
    "stuff_plus": lambda t: t.stuff(),
    "stuff_plus_of_targets": lambda t: t.mean_target(),
    "forest_facts": lambda t: stuff.forest_facts(t.predictions(), t.stuff()),
    "pitch_gap": lambda t: t.gap(),
    "pitch_gap_of_targets": lambda t: pitch_level.pitch_gap(t.mean_target(), t.grade()),
    "pitch_level_model": lambda t: t.pitch_level(),
    "pitch_level_model_of_targets": lambda t: t.pitch_level_of_targets(),
    "nastiness_features": _nastiness_features,
    "nastiness_standardized": _nastiness_standardized,
    "nastiness_correlations": lambda t: factors.correlations(
        nastiness.features(t.pitches()), S.NASTINESS_FEATURES),
    "spin_weights": _speed_weights,
    "nastiness_plus": lambda t: t.nastiness().select(
        "pitch_pk", "game_year", "nastiness_raw", "Nastiness_plus"),
    "nastiness_top200": _nastiest,
    "nastiness_distribution": lambda t: writers.distribution(t.nastiness(), "Nastiness_plus"),
    "game_state": _game_state,
    "final_scores": lambda t: G.final_scores(t.pitches()),
    "fielding_win": _fielding_win,
    "win_expectancy": lambda t: G.win_expectancy(G.game_state(t.pitches())),
    "run_expectancy": lambda t: G.run_expectancy(t.game_states()),
    "runs_scored_global": lambda t: _runs(t, G.runs_over_table),
    "runs_scored_game": lambda t: _runs(t, G.runs_in_game),
    "runs_remaining": lambda t: G.runs_remaining(t.game_states()).select(
        _pitch_pk().alias("pitch_pk"), "runs_scored", "runs_remaining"),
    "inning_runs": _inning_runs,
    "wpa": lambda t: t.pitch_values().select(
        _pitch_pk().alias("pitch_pk"), "runs_scored", "wp_before", "wp_after", "actual_wpa"),
    "run_value_residual": lambda t: t.clutch_values().select(
        _pitch_pk().alias("pitch_pk"), "rv_residual"),
    "high_leverage": _leverage_cutoff,
    "clutch_score": lambda t: t.clutch(),
    "clutch_top5": lambda t: _top(t.clutch(), "Clutch_Score"),
    "xwoba_two_level": lambda t: arsenal.xwoba_allowed(t.pitches()),
    "approach_angles": _approach_angles,
    "arsenal_profile_of_targets": lambda t: t.profile(t.mean_target()),
    "usage_weighted_base_of_targets": lambda t: arsenal.base_scores(t.profile(t.mean_target())),
    "k_rate_by_pitcher": lambda t: arsenal.k_rates(t.seasons(), t.players()),
    "arsenal_interactions_of_targets": _arsenal_interactions,
    "arsenal_advanced_of_targets": lambda t: arsenal.advanced_interactions(t.profile(t.mean_target())),
    "arsenal_interactions_by_scan_of_targets": _interactions_by_scan,
    "pitch_pair_sums": _pitch_pair_sums,
    "closest_pitches": _closest_pitches,
    "arsenal_features_of_targets": lambda t: arsenal.arsenal_features(t.profile(t.mean_target())),
    "arsenal_plus": lambda t: t.arsenal(),
    "arsenal_plus_of_targets": lambda t: t.fit_arsenal(t.mean_target())[0],
    "ridge_weights": lambda t: learn.weight_report(t.spark, t.fit_arsenal(t.stuff())[1]),
    "ridge_weights_of_targets": lambda t: learn.weight_report(
        t.spark, t.fit_arsenal(t.mean_target())[1]),
    "interaction_weights_by_factors_of_targets": _interaction_weights,
    "relievers": lambda t: relief.relievers(relief.games_pitched(t.pitches())),
    "relief_pitches": lambda t: relief.relief_pitches(t.pitches()).select("pitch_pk"),
    "entry_state": _entry_state,
    "inherited_value": _inherited,
    "relief_run_prevention_plus": lambda t: t.relief(),
    "relief_top5": lambda t: _top(t.relief(), "RRP_plus"),
    "pitcher_level_profile": lambda t: t.pitcher_level(None),
    "pitcher_level_model": lambda t: t.pitcher_level(t.arsenal()),
    "pitcher_level_model_of_targets": lambda t: t.pitcher_level(t.fit_arsenal(t.mean_target())[0]),
}


def queries() -> dict[str, Query]:
    def bound(build: Callable[[Models], DataFrame]) -> Query:
        return lambda spark, sf_dir: rounded(build(fixtures.models(spark, sf_dir)))
    return {name: bound(build) for name, build in QUERIES.items()}
