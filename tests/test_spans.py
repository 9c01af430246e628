"""Loads by spans of days: what is stored, what is rewritten, what a repeated or broken load does."""

from datetime import date, timedelta

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks import fixtures, run
from moundworks.sources import spans

SCHEMA = T.StructType().add("id", T.LongType()).add("day", T.DateType()).add("value", T.StringType())
D = date.fromisoformat


def days(spark, version="a", first="2023-11-20", n=90):
    rows = [(10 * k + i, D(first) + timedelta(days=k), f"{version}{k}") for k in range(n) for i in range(k % 3)]
    return spark.createDataFrame([*rows, (-1, None, "no day")], SCHEMA)


def reader(df, asked=None):
    def source(a, b):
        if asked is not None:
            asked.append((str(a), str(b)))
        return df.where(F.col("day").between(F.lit(a), F.lit(b)))
    return source


def rows(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return {str(f.relative_to(path)) for f in path.glob("data/*/*/part-*")}


def test_spans_are_merged_and_cut():
    a, b, c, d = map(D, ("2024-01-01", "2024-01-31", "2024-02-01", "2024-03-05"))
    assert spans.merged([(c, d), (a, b)]) == [(a, d)] == spans.merged([(a, c), (b, d), (b, b)])
    assert spans.uncovered((a, d), [(b, c)]) == [(a, D("2024-01-30")), (D("2024-02-02"), d)]
    assert spans.uncovered((b, c), [(a, d)]) == [] and spans.uncovered((a, b), [(c, d)]) == [(a, b)]
    assert spans.months([(D("2023-11-30"), D("2024-02-01"))]) == [(2023, 10), (2023, 11), (2024, 0), (2024, 1)]


def test_two_loads_equal_one_and_a_repeated_load_changes_nothing(spark, tmp_path):
    df, asked = days(spark), []
    table = spans.SpanTable(spark, str(tmp_path), SCHEMA, "day")
    assert table.read().count() == 0 and table.spans() == []
    first = table.load(reader(df, asked), D("2023-11-25"), D("2023-12-20"))
    second = table.load(reader(df, asked), D("2023-12-10"), D("2024-01-31"))
    want = df.where("day between '2023-11-25' and '2024-01-31'")
    assert rows(table.read()) == rows(want) and first + second == want.count()
    assert asked == [("2023-11-25", "2023-12-20"), ("2023-12-21", "2024-01-31")]
    assert table.spans() == [(D("2023-11-25"), D("2024-01-31"))]
    before = files(tmp_path)
    assert table.load(reader(df, asked), D("2023-12-01"), D("2024-01-31")) == 0 and len(asked) == 2
    assert files(tmp_path) == before
    assert rows(table.read(D("2023-12-05"), D("2023-12-06"))) == rows(df.where("day between '2023-12-05' and '2023-12-06'"))


def test_a_refresh_rewrites_its_months_only_and_takes_removals_in(spark, tmp_path):
    old, new = days(spark), days(spark, "b").where("month(day) <> 12")
    table = spans.SpanTable(spark, str(tmp_path), SCHEMA, "day")
    table.load(reader(old), D("2023-11-01"), D("2024-02-29"))
    before = files(tmp_path)
    table.load(reader(new), D("2023-11-25"), D("2023-12-31"), refresh=True)
    want = [r for r in rows(old.where("day is not null")) if not D("2023-11-25") <= r[1] <= D("2023-12-31")]
    want += rows(new.where("day between '2023-11-25' and '2023-12-31'"))
    assert rows(table.read()) == sorted(want)
    kept = {f for f in before if "load_year=2024" in f}
    assert kept and kept <= files(tmp_path) and not (before - kept) & files(tmp_path)
    assert not any("load_month=12" in f for f in files(tmp_path))
    assert table.manifest().count() == 2


def test_a_load_without_its_manifest_entry_is_done_again(spark, tmp_path):
    df = days(spark)
    table = spans.SpanTable(spark, str(tmp_path), SCHEMA, "day")
    table.load(reader(df), D("2023-11-01"), D("2023-12-31"))
    for f in sorted((tmp_path / "manifest").iterdir()):
        f.unlink()
    assert table.spans() == []
    table.load(reader(df), D("2023-11-01"), D("2024-03-31"))
    assert rows(table.read()) == rows(df.where("day is not null"))


def test_spans_without_rows_and_wrong_ones(spark, tmp_path):
    table = spans.SpanTable(spark, str(tmp_path), SCHEMA, "day")
    assert table.load(reader(days(spark)), D("1999-01-01"), D("1999-02-01")) == 0
    assert table.spans() == [(D("1999-01-01"), D("1999-02-01"))] and table.read().count() == 0
    with pytest.raises(ValueError):
        table.load(reader(days(spark)), D("2024-02-01"), D("2024-01-01"))


def test_build_reads_only_new_days(spark, tmp_path):
    fixtures.raw_pitches(spark, SMALL).write.partitionBy("game_year").parquet(f"{tmp_path}/pitches")
    fixtures.player_register(spark, SMALL).write.parquet(f"{tmp_path}/register")
    fixtures.season_lines(spark, SMALL).write.option("header", True).csv(f"{tmp_path}/seasons.csv")
    paths = (f"{tmp_path}/pitches", f"{tmp_path}/register", f"{tmp_path}/seasons.csv", f"{tmp_path}/out")
    some = run.build(spark, *paths, end="2024-12-31", incremental=True)["raw_statcast"].count()
    first = files(tmp_path / "out" / "pitches_by_span")
    tables = run.build(spark, *paths, incremental=True)
    assert 0 < some < 6000 == tables["raw_statcast"].count()
    assert tables["pitcher_strike_plus"].count() == 276
    assert first < files(tmp_path / "out" / "pitches_by_span")


def test_a_load_of_few_months_is_not_shuffled(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, date(2024, i % 12 + 1, 1 + i % 28)) for i in range(200)], "id long, day date")
    table = spans.SpanTable(spark, str(tmp_path / "few"), rows.schema, "day")
    hints, hint = [], type(rows).hint
    monkeypatch.setattr(type(rows), "hint", lambda df, *args: (hints.append(args[0]), hint(df, *args))[1])
    table.load(lambda a, b: rows.where(F.col("day").between(F.lit(a), F.lit(b))), date(2024, 1, 1), date(2024, 12, 31))
    assert hints == ["rebalance"]
    table.load(lambda a, b: rows.where(F.col("day").between(F.lit(a), F.lit(b))), date(2024, 3, 1), date(2024, 5, 9), True)
    assert hints == ["rebalance"]
    assert sorted(table.read().collect()) == sorted(rows.collect())
