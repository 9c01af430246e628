"""A session with the settings the plans were tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot never compiles methods above 8000 bytes; wide projections run faster uncollapsed
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """For tests and benchmarks; on a cluster put SETTINGS into spark-defaults instead."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("moundworks")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.driver.memory", memory))
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
