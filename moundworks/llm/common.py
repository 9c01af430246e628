"""What the operators share: input tables, stage tables in the shared folder, worker caches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from moundworks.storage import shared_dir

#: Spark removes the shuffle files of a query when it ends, instead of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text a Python worker takes at a time; Spark's batches count rows, which may be long.
TEXT_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(operator: str) -> dict:
    """A dictionary over all tasks of an operator in a Python worker, which drops what another left there."""
    cache = sys.modules.setdefault("_moundworks_worker", types.ModuleType("_moundworks_worker")).__dict__
    if cache.get("operator") != operator:
        cache.clear()
        pa.default_memory_pool().release_unused()
        cache["operator"] = operator
    return cache


def by_size(batches: Iterator[pa.RecordBatch], most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about ``most`` bytes of ``text``, or of one longer text."""
    for batch in batches:
        part = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), dtype=np.int64) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each ends; the session's setting comes back."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Stages:
    """Tables one operator writes to the shared folder and reads back, which cuts their lineage."""

    def __init__(self, spark: SparkSession, operator: str, compression: str = "snappy"):
        base = shared_dir(spark)
        if base is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        self.compression = compression
        self.spark, self.root = spark, f"{base.rstrip('/')}/{operator}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame) -> DataFrame:
        with shuffles_removed(self.spark):
            df.write.option("compression", self.compression).parquet(self.folder(name))
        return self.spark.read.schema(df.schema).parquet(self.folder(name))

    def remove(self, *names: str) -> None:
        """Delete stage tables that later stages have replaced."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.folder(name))
            path.getFileSystem(conf).delete(path, True)
