"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundworks.llm.common import Stages


def _starred(links: DataFrame, lowest: DataFrame) -> DataFrame:
    """Neighbours and the lowest node each is next to; the lowest are unique, so AQE splits hot nodes."""
    return links.join(lowest, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
    return _starred(both, lowest).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    lowest = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = _starred(links, lowest).where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame, stages: Stages, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node in ``links``; the component is its smallest node.

    Each round writes its links to the shared folder; the rounds end when the links are stars,
    which one more round leaves unchanged. Rounds grow with the logarithm of the longest path.
    """
    a, b = F.col(u), F.col(v)
    links = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    seen, step = None, 0
    while True:
        name = f"links-{step}"
        links = stages.write(name, links)
        state = links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step:
            stages.remove(f"links-{step - 1}")
        if state == seen:
            break
        seen, step = state, step + 1
        links = _small_star(_large_star(links))
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
