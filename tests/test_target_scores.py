"""Scores of mean targets need three columns of the training matrix, and read the pitches once."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.models import Models
from moundworks.plans import arsenal, stuff
from moundworks.storage import Workspace


@pytest.fixture(scope="module")
def raw(spark):
    """Two pitchers, two pitch types, 1,200 pitches; every 50th has no speed."""
    values = {"pitcher": "id % 2", "game_pk": "floor(id / 40)", "at_bat_number": "id % 40", "pitch_number": "1",
              "pitch_type": "if(id % 3 = 0, 'FF', 'SL')", "description": "if(id % 4 = 0, 'foul', 'swinging_strike')",
              "release_speed": "if(id % 50 = 7, null, 80 + id % 13)", "game_year": "2024", "vy0": "-130", "ay": "25", "az": "-15",
              "estimated_woba_using_speedangle": "id % 10 / 10"}
    rows = spark.range(1200)
    return rows.select(*[
        F.lit(date(2024, 6, 1)).alias(f.name) if f.name == "game_date" else
        F.expr(values.get(f.name, "if(id % 7 = 0, 1, 2) + id % 11" if f.dataType.typeName() != "string" else "'x'"))
        .cast(f.dataType).alias(f.name) for f in S.RAW_PITCHES.fields])


def models(spark, raw, path) -> Models:
    return Models(spark, Workspace(spark, str(path)), lambda: raw, None, None)


def test_mean_targets_write_no_matrix_and_do_not_differ_from_it(spark, raw, tmp_path):
    lazy = models(spark, raw, tmp_path / "lazy")
    found = sorted(lazy.mean_target("stuff", "velo").collect())
    assert not (tmp_path / "lazy" / "stuff_matrix").exists()
    stored = models(spark, raw, tmp_path / "stored")
    matrix = stored.stuff_matrix()
    assert stored.training_rows() is matrix and 0 < matrix.count() < 1200
    assert len(found) == 4
    for mine, theirs in zip(found, sorted(stored.mean_target("stuff", "velo").collect())):
        assert mine[:3] == theirs[:3] and mine[3:] == pytest.approx(theirs[3:])
    assert sorted(lazy.training_rows().collect()) == sorted(stuff.training_matrix(stored.pitches()).collect())


def test_interactions_compute_their_profile_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def seen(value):
        counted.add(1)
        return value

    rows = [(1, 2024, t, 0.5, 90.0 + i, 1.0 * i, 2.0 * i, -5.0 - i, 0.4 + i) for i, t in enumerate(["FF", "SL"])]
    profile = spark.createDataFrame(
        rows, "pitcher long, game_year int, pitch_type string, usage_weight double, avg_velo double, avg_ivb double, "
              "avg_hb double, avg_vaa double, stuff_value double")
    through = F.udf(seen, "double").asNondeterministic()
    got = arsenal.interactions(profile.withColumn("avg_velo", through("avg_velo"))).collect()
    assert len(got) == 1 and got[0]["velo_int"] == pytest.approx(0.25)
    assert counted.value == 2  # once a row
