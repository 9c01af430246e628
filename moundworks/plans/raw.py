"""The three ingested tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.functions.text import coerce_numeric, full_name
from moundworks.operators.metrics import keep_latest, league_index, weighted_means


def season_numbers(raw: DataFrame) -> DataFrame:
    """Season lines under their working names, numeric text parsed."""
    return coerce_numeric(raw.withColumnsRenamed(S.SEASON_RENAMES), S.SEASON_NUMERIC)


def league_means(seasons: DataFrame) -> DataFrame:
    """ERA and FIP of each season, weighted by innings."""
    return weighted_means(seasons, ["game_year"], "innings_pitched",
                          {"league_ERA": "ERA", "league_FIP": "FIP"})


def season_stats(raw: DataFrame) -> DataFrame:
    """Season lines with ERA+ and FIP+."""
    seasons = season_numbers(raw)
    return seasons.join(league_means(seasons), "game_year", "left").withColumns({
        f"{m}_plus": league_index(F.col(f"league_{m}"), F.col(m)) for m in ("ERA", "FIP")
    })


def pitch_table(raw: DataFrame) -> DataFrame:
    """Pitch events with outcome flags and key, all added in the one pass that stores them."""
    return raw.withColumns({**P.outcome_flags(), "pitch_pk": P.composite_key(*S.PITCH_KEY)})


def player_map(register: DataFrame) -> DataFrame:
    """One row per MLB id: the latest season played, then the smallest Retrosheet key."""
    named = register.select(*S.REGISTER_COLUMNS).withColumn(
        "full_name", full_name(F.col("name_first"), F.col("name_last")))
    last = F.col("mlb_played_last")
    return keep_latest(named, "key_mlbam", [last.isNull(), -last, F.col("key_retro")])
