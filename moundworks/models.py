"""The tables the reports are joined from, each computed once per input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moundworks import schema as S
from moundworks.operators import states as G
from moundworks.plans import (
    arsenal, clutch, nastiness, pitch_level, pitcher_level, raw, relief, stuff)
from moundworks.sources.readers import register
from moundworks.storage import Workspace

Source = Callable[[], DataFrame]


class Models:
    """Ingested tables, score tables and reports over three raw relations.

    Tables that several reports join are stored in the workspace on first use.
    """

    def __init__(self, spark: SparkSession, workspace: Workspace, raw_pitches: Source,
                 player_register: Source, season_lines: Source):
        self.spark, self.workspace = spark, workspace
        self.raw_pitches, self.player_register, self.season_lines = (
            raw_pitches, player_register, season_lines)

    def pitches(self) -> DataFrame:
        """Flagged pitch events, partitioned by season so season filters skip files."""
        return self.workspace.table(
            "raw_statcast", lambda: raw.pitch_table(self.raw_pitches()), partition_by=["game_year"])

    def players(self) -> DataFrame:
        return self.workspace.table(
            "player_id_map", lambda: raw.player_map(self.player_register()))

    def seasons(self) -> DataFrame:
        return self.workspace.table(
            "pitcher_season_stats", lambda: raw.season_stats(self.season_lines()))

    def register_views(self) -> None:
        """The ingested tables for ``spark.sql``."""
        register(self.pitches(), "raw_statcast")
        register(self.players(), "player_id_map")
        register(self.seasons(), "pitcher_season_stats")

    def stuff_matrix(self) -> DataFrame:
        return self.workspace.table("stuff_matrix", lambda: stuff.training_matrix(self.pitches()))

    def stuff(self) -> DataFrame:
        """Scores of the predictions, which are stored only where single ones are asked for as well."""
        def build() -> DataFrame:
            stored = self.workspace.stored("pitch_predictions")
            return stuff.stuff_plus(
                stuff.predictions(self.stuff_matrix(), S.ARSENAL_KEY) if stored is None else stored)
        return self.workspace.table("pitcher_stuff", build)

    def predictions(self) -> DataFrame:
        """The forests' predictions per pitch."""
        return self.workspace.table(
            "pitch_predictions", lambda: stuff.predictions(self.stuff_matrix()))

    def training_rows(self) -> DataFrame:
        """The training matrix for one reader: the stored one if there is one, else only the columns that
        are read are computed, and nothing is shuffled or written."""
        stored = self.workspace.stored("stuff_matrix")
        return stuff.training_matrix(self.pitches()) if stored is None else stored

    def mean_target(self, *scores: str) -> DataFrame:
        """Stuff scores SQL can compute: the mean target instead of the mean prediction."""
        names = scores or ("stuff",)
        return self.workspace.table("_".join(["target_scores", *names]), lambda: stuff.type_scores(
            self.training_rows(), dict.fromkeys(names, "target")))

    def grade(self) -> DataFrame:
        return self.workspace.table("pitch_grade", lambda: pitch_level.pitch_grade(self.pitches()))

    def gap(self) -> DataFrame:
        return self.workspace.table(
            "pitcher_pitch_gap", lambda: pitch_level.pitch_gap(self.stuff(), self.grade()))

    def nastiness(self) -> DataFrame:
        return nastiness.nastiness_plus(self.pitches())

    def game_states(self) -> DataFrame:
        """Narrow pitch rows with game state and runs, read by all expectancy and relief steps."""
        return self.workspace.table("game_states", lambda: G.runs_in_game(
            G.game_state(self.pitches().select(*relief.NEEDED))))

    def win_table(self) -> DataFrame:
        return self.workspace.table("win_expectancy", lambda: G.win_expectancy(self.game_states()))

    def run_table(self) -> DataFrame:
        return self.workspace.table("run_expectancy", lambda: G.run_expectancy(self.game_states()))

    def pitch_values(self) -> DataFrame:
        return clutch.pitch_values(self.pitches(), self.win_table())

    def clutch_values(self) -> DataFrame:
        return self.workspace.table("clutch_pitch_values", self.pitch_values)

    def clutch(self) -> DataFrame:
        return self.workspace.table("pitcher_clutch", lambda: clutch.clutch(self.clutch_values()))

    def appearances(self) -> DataFrame:
        return self.workspace.table("appearances", lambda: relief.appearances(self.game_states()))

    def relief(self) -> DataFrame:
        return self.workspace.table("relief_run_prevention_plus", lambda: relief.relief_run_prevention(
            self.appearances(), self.run_table(), self.win_table()))

    def profile(self, stuff_values: DataFrame) -> DataFrame:
        return arsenal.pitch_profile(self.pitches(), stuff_values)

    def fit_arsenal(self, stuff_values: DataFrame) -> tuple[DataFrame, dict]:
        return arsenal.arsenal_scores(
            arsenal.arsenal_features(self.profile(stuff_values)),
            arsenal.k_rates(self.seasons(), self.players()), arsenal.xwoba_allowed(self.pitches()))

    def arsenal(self) -> DataFrame:
        return self.workspace.table("arsenal_plus", lambda: self.fit_arsenal(self.stuff())[0])

    def pitch_level(self) -> DataFrame:
        return pitch_level.pitch_level_model(
            self.pitches(), self.grade(), self.stuff(), self.gap(), self.players())

    def pitch_level_of_targets(self) -> DataFrame:
        stuff_scores = self.mean_target("stuff", "shape", "velo")
        return pitch_level.pitch_level_model(
            self.pitches(), self.grade(), stuff_scores,
            pitch_level.pitch_gap(stuff_scores, self.grade()), self.players())

    def pitcher_level(self, arsenal_scores: DataFrame | None) -> DataFrame:
        return pitcher_level.pitcher_level_model(
            self.pitches(), self.players(), self.seasons(), self.clutch(), self.relief(),
            arsenal_scores)
