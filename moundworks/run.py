"""Build every table and report from files of raw data.

    python -m moundworks.run --pitches P --register R --seasons S --out DIR

``P`` holds parquet pitch events, ``R`` and ``S`` parquet or CSV. Tables are written below ``DIR``;
the reports also as CSV.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.models import Models
from moundworks.plans import nastiness, pitch_level, pitcher_level
from moundworks.sources import readers, spans, writers
from moundworks.storage import Workspace

METRICS = {
    "pitcher_whiff_plus": pitch_level.whiff_plus,
    "pitcher_contact_plus": pitch_level.contact_plus,
    "pitcher_strike_plus": pitch_level.strike_plus,
    "pitcher_ball_plus": pitch_level.ball_plus,
    "pitcher_chase_plus": pitch_level.chase_plus,
}


def build(spark: SparkSession, pitches: str, register: str, seasons: str, out: str,
          start: str = "2021-03-01", end: str = "2025-12-31", top_season: int = 2025,
          incremental: bool = False) -> dict[str, DataFrame]:
    """All stored tables by name.

    ``incremental`` keeps the pitches of earlier runs below ``out`` and reads only days not stored yet.
    """
    def raw_pitches() -> DataFrame:
        if not incremental:
            return readers.read_pitches(spark, pitches, start, end)
        table = spans.SpanTable(spark, f"{out}/pitches_by_span", S.RAW_PITCHES, "game_date")
        first, last = date.fromisoformat(start), date.fromisoformat(end)
        table.load(lambda a, b: readers.read_pitches(spark, pitches, a.isoformat(), b.isoformat()), first, last)
        return table.read(first, last)

    models = Models(
        spark, Workspace(spark, out), raw_pitches,
        lambda: readers.read_player_register(spark, register),
        lambda: readers.read_season_stats(spark, seasons, int(start[:4]), int(end[:4])))
    keep = models.workspace.table
    tables = {
        "raw_statcast": models.pitches(), "player_id_map": models.players(),
        "pitcher_season_stats": models.seasons(),
    }
    for name, metric in METRICS.items():
        tables[name] = keep(name, lambda metric=metric: metric(models.pitches()))
    tables |= {
        "pitch_grade": models.grade(),
        "pitcher_stuff": models.stuff(),
        "pitcher_pitch_gap": models.gap(),
        "pitch_nastiness": keep("pitch_nastiness", models.nastiness),
        "pitcher_clutch": models.clutch(),
        "arsenal_plus": models.arsenal(),
        "relief_run_prevention_plus": models.relief(),
        "pitch_level_model": keep("pitch_level_model", models.pitch_level),
        "pitcher_level_model": keep(
            "pitcher_level_model", lambda: models.pitcher_level(models.arsenal())),
    }
    writers.export_csv(tables["pitch_level_model"], f"{out}/pitch_level_model_csv",
                       pitch_level.pitch_level_order())
    writers.export_csv(tables["pitcher_level_model"], f"{out}/pitcher_level_model_csv",
                       pitcher_level.order())
    writers.export_csv(tables["pitch_nastiness"].where(F.col("game_year") == top_season),
                       f"{out}/pitch_nastiness_model_csv", nastiness.top_order(), limit=200)
    return tables


if __name__ == "__main__":
    parser = argparse.ArgumentParser(description=__doc__)
    for option in ("pitches", "register", "seasons", "out"):
        parser.add_argument(f"--{option}", required=True)
    parser.add_argument("--incremental", action="store_true")
    parser.add_argument("--start", default="2021-03-01")
    parser.add_argument("--end", default="2025-12-31")
    args = parser.parse_args()
    session = SparkSession.builder.appName("moundworks").getOrCreate()
    for table_name, table in build(session, **vars(args)).items():
        writers.row_count(table, table_name).show(truncate=False)
