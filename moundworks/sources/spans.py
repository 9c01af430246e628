"""A stored table that is loaded by spans of days, so a new season rewrites its own partitions only.

The table is partitioned by the year and month of its date. A load reads the days that no earlier load
covered (or, to take corrections in, all days of its span), adds the stored rows of the touched months
that lie outside them, and overwrites just those months. A manifest lists the spans that are stored;
its entry is written after the data, and a load that was interrupted is done again with the same
result. Rows are counted while they are written, without a second pass.

Rows whose date is unknown are in no span. Loads of one table must not run at the same time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.storage import COMPILED_BYTES, _exists, _hadoop_fs, _hadoop_path, settings

Span = tuple[date, date]
PARTS = ["load_year", "load_month"]
MANIFEST = "start date, end date, n_rows long, load long"
DAY = timedelta(days=1)
#: A load of so few months is written by the tasks that read it, each with a file per month.
OPEN_MONTHS = 8


def merged(spans: list[Span]) -> list[Span]:
    """Disjoint spans in order; those that touch are one."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1] + DAY:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def uncovered(span: Span, covered: list[Span]) -> list[Span]:
    """The parts of a span that disjoint ordered spans leave open."""
    out, at = [], span[0]
    for start, end in covered:
        if end < at or start > span[1]:
            continue
        if start > at:
            out.append((at, start - DAY))
        at = max(at, end + DAY)
    return out + [(at, span[1])] * (at <= span[1])


def months(spans: list[Span]) -> list[tuple[int, int]]:
    """(year, month) of every month that a span touches."""
    numbers = {n for start, end in spans
               for n in range(start.year * 12 + start.month - 1, end.year * 12 + end.month)}
    return [divmod(n, 12) for n in sorted(numbers)]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class SpanTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str):
        self.spark, self.path, self.schema, self.day = spark, path.rstrip("/"), schema, day
        self.stored = T.StructType([*schema.fields, *(T.StructField(p, T.IntegerType()) for p in PARTS)])

    def manifest(self) -> DataFrame:
        """(start, end, n_rows, load) of every load."""
        if not _exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    def spans(self) -> list[Span]:
        """What is stored; one row per load reaches the driver."""
        return merged([(r["start"], r["end"]) for r in self.manifest().select("start", "end").distinct().collect()])

    def _within(self, spans: list[Span]) -> Column:
        return _any([F.col(self.day).between(F.lit(a), F.lit(b)) for a, b in spans])

    def _in_months(self, spans: list[Span]) -> Column:
        return _any([(F.col(PARTS[0]) == y) & (F.col(PARTS[1]) == m + 1) for y, m in months(spans)])

    def _scan(self, spans: list[Span]) -> DataFrame:
        data = f"{self.path}/data"
        if not _exists(self.spark, data):
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(data).where(self._in_months(spans))

    def read(self, start: date | None = None, end: date | None = None) -> DataFrame:
        """The stored rows of a span (of all spans by default); other months are not read."""
        covered = self.spans()
        if not covered:
            return self.spark.createDataFrame([], self.schema)
        span = start or covered[0][0], end or covered[-1][1]
        return self._scan([span]).where(self._within([span])).select(*self.schema.fieldNames())

    def load(self, source: Callable[[date, date], DataFrame], start: date, end: date,
             refresh: bool = False) -> int:
        """Store the days of a span that are not stored yet, or all of them; returns the rows stored.

        ``source`` gives the rows between two days.
        """
        if end < start:
            raise ValueError(f"the span ends on {end}, before {start}")
        spans = [(start, end)] if refresh else uncovered((start, end), self.spans())
        if not spans:
            return 0
        names, touched = self.schema.fieldNames(), months(spans)
        new = reduce(DataFrame.unionByName, [source(a, b).select(*names) for a, b in spans]).where(
            self._within(spans)).withColumns({PARTS[0]: F.year(self.day), PARTS[1]: F.month(self.day)})
        rows = new.withColumn("is_new", F.lit(1)).unionByName(
            self._scan(spans).where(~self._within(spans)).withColumn("is_new", F.lit(0)))
        seen = Observation()
        # the number of rows of each touched month, and of new ones
        in_month = [(F.col(PARTS[0]) == y) & (F.col(PARTS[1]) == m + 1) for y, m in touched]
        numbers = [F.coalesce(F.sum("is_new"), F.lit(0)).alias("n_new"),
                   *[F.count(F.when(c, 1)).alias(f"month_{i}") for i, c in enumerate(in_month)]]
        stored = rows.observe(seen, *numbers).select(*names, *PARTS)
        if len(touched) > OPEN_MONTHS:  # many tasks times many months would be many small files
            stored = stored.hint("rebalance", *PARTS)
        with settings(self.spark, COMPILED_BYTES | {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_MONTHS)}):
            stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(
                f"{self.path}/data")
        try:
            counts = seen.get
        except Py4JJavaError:  # a plan that turns out to have no rows loses its observation
            counts = rows.agg(*numbers).first().asDict()
        for i, (y, m) in enumerate(touched):
            if not counts[f"month_{i}"]:  # dynamic overwriting leaves a month without rows as it was
                folder = f"{self.path}/data/{PARTS[0]}={y}/{PARTS[1]}={m + 1}"
                _hadoop_fs(self.spark, folder).delete(_hadoop_path(self.spark, folder), True)
        number = (self.manifest().agg(F.max("load")).first()[0] or 0) + 1
        self.spark.createDataFrame(
            [(a, b, counts["n_new"] if i == 0 else 0, number) for i, (a, b) in enumerate(spans)], MANIFEST
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return counts["n_new"]
