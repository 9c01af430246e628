"""Where stage tables live: the shared folder the cluster names in ``spark.checkpoint.dir``.

A stage table (raw pitches, training matrix, pitcher_stuff, ...) is written once and read back,
so later plans scan pruned parquet columns, Catalyst knows the real size of what it joins, and a
lost executor re-reads files instead of recomputing a long lineage.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_CELLS = 5_000_000
#: HotSpot never compiles longer methods; Spark's own limit is the JVM's, eight times as much.
COMPILED_BYTES = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: A task that writes few partition values keeps their files open and does not sort its rows by them.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "8"}


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; else one in the warehouse that executors share.

    Only a session that runs in one process (``local``) takes a folder of this machine; on a cluster
    whose warehouse is one, the folder has to be named. The caller's settings stay as they are.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master == "local" or context.master.startswith("local["):
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="moundworks-")
        return _LOCAL_FOLDERS[context.applicationId]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("file:", "/")) or ":" not in warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: "
                           f"{warehouse} may be a folder of one machine")
    return f"{warehouse.rstrip('/')}/_moundworks"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the queries run inside; the session's own come back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an intermediate that several plans read or that must not change.

    Steps over many columns become one method per stage; those that would run uncompiled are split.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with settings(df.sparkSession, COMPILED_BYTES):
        return df.checkpoint(eager=True)


def sized_lookup(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A narrow keyed table, ready to be joined to a large one.

    It is computed once and counted. Only a counted table of few rows and cells gets the broadcast
    hint; a larger one joins by shuffle, where AQE splits skewed partitions of the large side.
    """
    max_rows = min(max_rows, MAX_BROADCAST_CELLS // max(len(table.columns), 1))
    table = cut_lineage(table)
    if table.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(table)
    return table


class Workspace:
    """Named stage tables under one folder, each built on first use."""

    def __init__(self, spark: SparkSession, root: str | None):
        self.spark, self.root = spark, root
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def for_inputs(cls, spark: SparkSession, paths: list[str]) -> Workspace:
        """One workspace per application and content state of the input files."""
        stamps = [spark.sparkContext.applicationId]
        for path in paths:  # a folder is listed: its own entry may not change with its files
            for status in _hadoop_fs(spark, path).listStatus(_hadoop_path(spark, path)):
                stamps.append(f"{status.getPath()}:{status.getLen()}:{status.getModificationTime()}")
        key = hashlib.sha1("|".join(stamps).encode()).hexdigest()[:16]
        folder = shared_dir(spark)
        if (spark, key) not in _OPEN:
            _OPEN[(spark, key)] = cls(spark, folder and f"{folder}/moundworks/{key}")
        return _OPEN[(spark, key)]

    def new_path(self, name: str) -> str:
        """A path nothing was written to."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def stored(self, name: str) -> DataFrame | None:
        """The table if it was built before."""
        if name in self._tables and _exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
            return self._tables[name]
        return None

    def table(self, name: str, build: Callable[[], DataFrame],
              partition_by: list[str] | None = None) -> DataFrame:
        """The stored result of ``build``."""
        if self.root is None:
            return build()
        path, found = f"{self.root}/{name}", self.stored(name)
        if found is not None:
            return found
        df = build()
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with settings(self.spark, COMPILED_BYTES | OPEN_FILES):
            writer.parquet(path)
        self._tables[name] = self.spark.read.schema(df.schema).parquet(path).select(*_quoted(df))
        return self._tables[name]


_OPEN: dict[tuple[SparkSession, str], Workspace] = {}


def _quoted(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _hadoop_fs(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _hadoop_fs(spark, path).exists(_hadoop_path(spark, path))
