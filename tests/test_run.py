import pandas as pd
from conftest import MEDIUM, SMALL

import __spark_entry__ as entry
from moundworks import fixtures, registry, run


def test_build_from_files(spark, tmp_path):
    fixtures.raw_pitches(spark, SMALL).write.partitionBy("game_year").parquet(f"{tmp_path}/pitches")
    fixtures.player_register(spark, SMALL).write.parquet(f"{tmp_path}/register")
    fixtures.season_lines(spark, SMALL).write.option("header", True).csv(f"{tmp_path}/seasons.csv")
    out = f"{tmp_path}/out"
    tables = run.build(spark, f"{tmp_path}/pitches", f"{tmp_path}/register", f"{tmp_path}/seasons.csv", out)
    assert tables["raw_statcast"].count() == 6000
    assert tables["pitcher_strike_plus"].count() == 276
    assert tables["pitcher_clutch"].count() > 0
    assert tables["pitcher_level_model"].count() == 0  # the arsenal needs 50 pitches of a type
    top = pd.concat(pd.read_csv(f) for f in tmp_path.glob("out/pitch_nastiness_model_csv/part-*.csv"))
    assert len(top) == 200 and top["Nastiness_plus"].is_monotonic_decreasing
    assert set(top["game_year"]) == {2025}


def test_final_tables_have_the_rows_of_the_queries(spark, tmp_path):
    fixtures.raw_pitches(spark, MEDIUM).write.partitionBy("game_year").parquet(f"{tmp_path}/pitches")
    fixtures.player_register(spark, MEDIUM).write.parquet(f"{tmp_path}/register")
    fixtures.season_lines(spark, MEDIUM).write.parquet(f"{tmp_path}/seasons")
    tables = run.build(spark, *(f"{tmp_path}/{name}" for name in ("pitches", "register", "seasons", "out")))
    for name in ("pitch_level_model", "pitcher_level_model"):
        mine = registry.rounded(tables[name]).toPandas()
        theirs = entry.queries()[name](spark, MEDIUM).toPandas()
        key = [c for c in ("pitcher", "season", "pitch_type") if c in mine.columns]
        assert len(mine) > 0
        pd.testing.assert_frame_equal(mine.sort_values(key, ignore_index=True),
                                      theirs.sort_values(key, ignore_index=True),
                                      check_dtype=False)  # a season read from a path is an int
        exported = pd.concat(pd.read_csv(f) for f in sorted(tmp_path.glob(f"out/{name}_csv/part-*.csv")))
        assert list(exported["pitcher"]) == sorted(mine["pitcher"])
