"""Files are read by column name and typed, whatever their order and storage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from moundworks import fixtures
from moundworks import schema as S
from moundworks.operators import learn
from moundworks.sources import readers


def test_csv_columns_in_another_order(spark, tmp_path):
    register = fixtures.player_register(spark, SMALL)
    other = register.select(*reversed(register.columns)).withColumn("birth_year", F.lit(1990))
    other.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{tmp_path}/register")
    again = readers._read(spark, f"{tmp_path}/register", S.PLAYER_REGISTER, "player register", "csv")
    want = {tuple(r) for r in register.select(*S.PLAYER_REGISTER.fieldNames()).collect()}
    got = {tuple(r) for r in again.select(*S.PLAYER_REGISTER.fieldNames()).collect()}
    assert got == {tuple(None if v == "" else v for v in r) for r in want}
    assert "birth_year" in again.columns
    assert [f.dataType for f in again.select(*S.PLAYER_REGISTER.fieldNames()).schema] == [
        f.dataType for f in S.PLAYER_REGISTER.fields]


def test_parquet_with_text_dates_and_float_ids(spark, tmp_path):
    pitches = fixtures.models(spark, SMALL).pitches().select(*S.RAW_PITCHES.fieldNames())
    loose = pitches.withColumns({"game_date": F.col("game_date").cast("string"),
                                 "on_1b": F.coalesce(F.col("on_1b").cast("double"), F.lit(float("nan"))),
                                 "pitcher": F.col("pitcher").cast("double")})
    loose.write.parquet(f"{tmp_path}/loose")
    again = readers.read_pitches(spark, f"{tmp_path}/loose").select(*S.RAW_PITCHES.fieldNames())
    assert [f.dataType for f in again.schema] == [f.dataType for f in S.RAW_PITCHES.fields]
    pitches = pitches.select(*[F.col(f.name).cast(f.dataType) for f in S.RAW_PITCHES.fields])
    assert again.exceptAll(pitches).count() == 0 and again.count() == pitches.count()


def test_ridge_leaves_rows_with_unknown_features_out(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"i": range(200), "a": rng.normal(size=200), "b": rng.normal(size=200)})
    frame["y"] = 2 * frame.a - frame.b
    rows = [(int(i), None if i % 4 == 0 else float(a), float(b), float(y))
            for i, a, b, y in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y double")
    model = learn.ridge_cv(df, ["a", "b"], "y", ["i"])
    whole = learn.ridge_cv(df.where("a is not null"), ["a", "b"], "y", ["i"])
    assert model.alpha == whole.alpha == pytest.approx(0.001)
    assert model.coefficients == pytest.approx(whole.coefficients)
    assert model.coefficients == pytest.approx([2, -1], abs=1e-4)
    assert model.predict(df, "p").where("a is null and p is not null").count() == 0


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_named_folder_uses_the_warehouse(master):
    from types import SimpleNamespace as Fake

    from moundworks.storage import shared_dir
    settings = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse"}
    fake = Fake(conf=Fake(get=lambda key, default=None: settings.get(key, default)),
                sparkContext=Fake(master=master, getCheckpointDir=lambda: None))
    assert shared_dir(fake) == "hdfs://shared/warehouse/_moundworks"


@pytest.mark.parametrize("warehouse", ["file:/home/me/spark-warehouse", "/home/me/spark-warehouse", "spark-warehouse"])
def test_a_cluster_does_not_write_to_folders_of_one_machine(warehouse):
    from types import SimpleNamespace as Fake

    from moundworks.storage import shared_dir
    settings = {"spark.sql.warehouse.dir": warehouse}
    fake = Fake(conf=Fake(get=lambda key, default=None: settings.get(key, default)),
                sparkContext=Fake(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)
    settings["spark.checkpoint.dir"] = "file:/mnt/shared"
    assert shared_dir(fake) == "file:/mnt/shared"


def test_scan_of_a_large_group_equals_the_small_one(spark):
    from moundworks.operators.scan import row_position
    got = row_position(spark.range(3_000), "at", ["id"], task_rows=100)
    assert got.where("at != id").count() == 0
