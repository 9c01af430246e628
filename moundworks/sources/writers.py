"""Sinks and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fail_if_exists: bool = False) -> DataFrame:
    """Create or replace (or create only) a stored table and return a scan of it."""
    writer = df.write.mode("errorifexists" if fail_if_exists else "overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_as_table(df: DataFrame, name: str, fail_if_exists: bool = False) -> DataFrame:
    """The same through the session catalog."""
    df.write.mode("errorifexists" if fail_if_exists else "overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def export_csv(df: DataFrame, path: str, order_by: list[Column], limit: int | None = None) -> None:
    """Comma separated files with a header, in ``order_by`` order.

    A whole table is range partitioned: part files in name order are the sorted result, and no
    task holds it all. Only a top-k export, bounded by ``limit``, ends in a single file.
    """
    ordered = df.orderBy(*order_by)
    if limit is not None:
        ordered = ordered.limit(limit)
    ordered.write.mode("overwrite").option("header", True).option("sep", ",").csv(path)


def row_count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("relation"), "n_rows")


def distribution(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Row count, mean and sample deviation of a score."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(column), digits).alias("mean"),
        F.round(F.stddev_samp(column), digits).alias("std"),
    )
