"""Nastiness+: how far a pitch's shape lies from the average shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators.learn import pca_norm
from moundworks.operators.metrics import known, plus_score

# The published columns, in order.
SCAN_COLUMNS = [
    "pitch_pk", "pitcher", "player_name", "pitch_type", "pitch_name", "game_year", "description", "game_date",
    "inning", "inning_topbot", "outs_when_up", "balls", "strikes", "release_speed",
    "release_spin_rate", "release_pos_x", "release_pos_z", "release_extension", "pfx_x", "pfx_z",
]


def features(pitches: DataFrame) -> DataFrame:
    """Shape features of pitches thrown in earnest; incomplete rows are dropped."""
    thrown = pitches.where(
        (F.col("release_speed") >= S.MIN_SPEED) & (F.col("pitch_type") != S.UNSPECIFIED_FASTBALL)
    ).select(*SCAN_COLUMNS)
    return thrown.withColumns(P.movement()).withColumns({
        "ivb_abs": F.abs("ivb"),
        "hb_abs": F.abs("hb"),
        "spin": F.col("release_spin_rate"),
        "expected_movement": F.col("release_spin_rate") * S.SPIN_TO_MOVEMENT,
        "movement_total": P.length(F.col("ivb"), F.col("hb")),
        "movement_angle": P.break_direction(),
        "is_good_outcome": P.happened(S.NASTY_EVENTS),
    }).withColumns({
        "movement_over_expected": F.col("movement_total") - F.col("expected_movement"),
        "movement_sep": F.abs(F.col("ivb_abs") - F.col("hb_abs")) * 1.2,
    }).withColumn("movement_gap", F.abs("movement_over_expected")).where(
        known(*S.NASTINESS_FEATURES))


def nastiness_plus(pitches: DataFrame) -> DataFrame:
    """Components are fitted on every pitch; misses and called strikes of all seasons are scored."""
    raw = pca_norm(features(pitches), S.NASTINESS_FEATURES, "nastiness_raw", k=3)
    return plus_score(raw.where(F.col("is_good_outcome") == 1), {"Nastiness_plus": "nastiness_raw"})


def top_order() -> list[Column]:
    """Best first; equal scores by pitch key."""
    return [F.col("Nastiness_plus").desc(), F.col("pitch_pk").asc()]


def nastiest(scored: DataFrame, season: int = 2025, limit: int = 200) -> DataFrame:
    """The season's top pitches."""
    return scored.where(F.col("game_year") == season).orderBy(*top_order()).limit(limit)
