"""Scans. Filters and projections stay declarative so they reach the file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks import schema as S
from moundworks.functions.text import nan_to_null
from moundworks.operators.scan import row_position


def _read(spark: SparkSession, path: str, schema: T.StructType, what: str,
          file_format: str | None = None) -> DataFrame:
    """Columns are found by name, whatever their order, and cast to the schema's types.

    Values that do not parse, and NaN in nullable numbers, become NULL; columns that the schema does
    not name pass through. ``file_format`` is csv or parquet; by default the path's ending tells.
    """
    file_format = file_format or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    df = S.require_columns(reader.format(file_format).load(path), schema.fieldNames(), what)
    return df.withColumns({f.name: _typed(df.schema[f.name].dataType, f)
                           for f in schema.fields if df.schema[f.name].dataType != f.dataType})


def _typed(stored: T.DataType, field: T.StructField):
    value = F.col(f"`{field.name}`")
    if isinstance(stored, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
        if isinstance(field.dataType, T.StringType):  # ids that were stored as numbers
            whole = value.cast("long")
            value = F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))
    elif isinstance(stored, T.StringType):
        value = F.when(F.trim(value) != "", F.trim(value))
        if isinstance(field.dataType, (T.LongType, T.IntegerType)):
            number = value.try_cast("double")  # such as 10.0
            value = F.coalesce(value.try_cast("long"), F.when(~F.isnan(number), number).try_cast("long"))
    return value.try_cast(field.dataType)


def read_season_stats(spark: SparkSession, path: str,
                      start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Season lines of all pitchers, any number of innings."""
    df = _read(spark, path, S.SEASON_STATS, "season stats")
    return between(df, "Season", start_year, end_year)


def read_pitches(spark: SparkSession, path: str,
                 start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Pitch events of a date span; on data partitioned by ``game_year`` whole seasons are skipped."""
    df = _read(spark, path, S.RAW_PITCHES, "pitch events")
    df = between(df, "game_year", start_date and int(start_date[:4]), end_date and int(end_date[:4]))
    df = between(df, "game_date", start_date and F.lit(start_date).cast("date"),
                 end_date and F.lit(end_date).cast("date"))
    return nan_to_null(df)


def read_player_register(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, S.PLAYER_REGISTER, "player register")


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    """Closed range filter; a bound of None is open."""
    if low is not None:
        df = df.where(F.col(column) >= low)
    if high is not None:
        df = df.where(F.col(column) <= high)
    return df


def in_file_order(spark: SparkSession, path: str, schema: T.StructType, out: str) -> DataFrame:
    """Rows of CSV part files that were written with ``schema``; ``out`` numbers them as they stand there."""
    rows = spark.read.option("header", True).schema(schema).csv(path).select(
        "*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    return row_position(rows, out, ["file", "block", "line"]).drop("file", "block", "line")


def register(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` visible to ``spark.sql`` under ``name``."""
    df.createOrReplaceTempView(name)
    return df
