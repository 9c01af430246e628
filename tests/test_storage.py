"""Stage tables are written with the settings their wide plans need; the session keeps its own."""

from pyspark.sql.readwriter import DataFrameWriter

from moundworks import storage

NAMES = ["spark.sql.codegen.hugeMethodLimit", "spark.sql.maxConcurrentOutputFileWriters"]


def test_stage_tables_are_written_by_compiled_methods(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def recorded(self, *args, **kwargs):
        seen.append([int(spark.conf.get(n)) for n in NAMES])
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    before = [spark.conf.get(n) for n in NAMES]
    workspace = storage.Workspace(spark, str(tmp_path / "tables"))
    stored = workspace.table("t", lambda: spark.range(100).selectExpr("id", "id % 20 AS part"), ["part"])
    assert seen[0][0] <= 8000 and seen[0][1] > 0
    assert sorted(stored.collect()) == [(i, i % 20) for i in range(100)]  # more values than open files
    assert [spark.conf.get(n) for n in NAMES] == before


def test_checkpoints_are_written_by_compiled_methods(spark, monkeypatch):
    session_limit = spark.conf.get(NAMES[0])
    spark.conf.set(NAMES[0], "65535")
    rows, seen = spark.range(10), []
    checkpoint = type(rows).checkpoint

    def recorded(df, *args, **kwargs):
        seen.append(int(spark.conf.get(NAMES[0])))
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(type(rows), "checkpoint", recorded)
    try:
        assert storage.cut_lineage(rows).count() == 10
        assert seen == [8000] and spark.conf.get(NAMES[0]) == "65535"
    finally:
        spark.conf.set(NAMES[0], session_limit)
