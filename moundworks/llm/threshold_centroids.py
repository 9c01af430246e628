"""Centroid clustering over whole numbers, with nearest centroids found by the threshold algorithm.

Each dimension holds the centroids in a list sorted by value. From the place of a vector's value the
list is walked outward, nearer neighbour first, in all dimensions at once; a centroid met for the first
time gets its exact distance. One that no list has met is at least as far as the sum of the squared
gaps at the frontiers, so the walk ends when that sum strictly exceeds the best exact distance (on
equality a centroid of smaller number could still tie) or when no centroid is left to meet. Rounds
read a stored table; a task returns one row of sums per centroid, and the driver receives
centroids times dimensions.

Cases: rows whose vector is null, of another length, or holds null or non-finite components are left
out. A component x counts as floor(scale * x). Rows with one beyond ``MOST`` have no exact 64-bit
distance: they stay in the result with null cluster and distance and move no centroid. Repeated rows
are vectors of their own; starting vectors of one id are taken by value, those without an id last. With
fewer vectors than centroids every vector starts one. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import Stages

#: Whole-number components are smaller, so squared gaps of ``MAX_SIZE`` dimensions fit 64 bits.
MOST, MAX_SIZE = 1 << 27, 64
BLOCK_ROWS = 2_048
ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, n long, sums array<long>"


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of a tie) and its squared distance."""
    n, k = len(points), len(centroids)
    dims = np.arange(points.shape[1])
    order = np.argsort(centroids, axis=0, kind="stable")
    values = np.take_along_axis(centroids, order, 0)
    # the two frontiers of each list: the last value below and the first at or above the vector's
    right = (values[None] < points[:, None]).sum(1)
    left = right - 1
    far = np.iinfo(np.int64).max
    best, label = np.full(n, far), np.full(n, k)
    met = np.zeros((n, k), bool)
    rows = np.arange(n)
    while len(rows):
        x, lo, hi = points[rows], left[rows], right[rows]
        below = np.where(lo >= 0, x - values[np.maximum(lo, 0), dims], far)
        above = np.where(hi < k, values[np.minimum(hi, k - 1), dims] - x, far)
        down = below <= above
        gap = np.where(down, below, above)
        found = order[np.where(down, lo, hi), dims]
        left[rows] -= down
        right[rows] += ~down
        new = np.zeros((len(rows), k), bool)
        np.put_along_axis(new, found, True, 1)
        new &= ~met[rows]
        met[rows] |= new
        for c in np.flatnonzero(new.any(0)):
            at = rows[new[:, c]]
            rest = points[at] - centroids[c]
            distance = np.einsum("ij,ij->i", rest, rest)
            nearer = (distance < best[at]) | ((distance == best[at]) & (c < label[at]))
            best[at[nearer]], label[at[nearer]] = distance[nearer], c
        frontier = np.einsum("ij,ij->i", gap, gap)
        rows = rows[(frontier <= best[rows]) & ~met[rows].all(1)]
    return label, best


def _blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    for a in range(0, batch.num_rows, BLOCK_ROWS):
        rows = batch.column("vector").slice(a, BLOCK_ROWS)
        yield slice(a, a + len(rows)), rows.flatten().to_numpy().reshape(-1, size)


def summer(centroids: np.ndarray):
    """Per task and centroid the number and the sums of its vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, points in _blocks(batch, centroids.shape[1]):
                label, _ = nearest(points, centroids)
                n += np.bincount(label, minlength=len(centroids))
                np.add.at(sums, label, points)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(own.astype(np.int32)), "n": pa.array(n[own]),
            "sums": pa.array(sums[own].tolist(), pa.list_(pa.int64()))})
    return run


def assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, best = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, points in _blocks(batch, centroids.shape[1]):
                label[at], best[at] = nearest(points, centroids)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "cluster": pa.array(label), "distance": pa.array(best)})
    return run


def whole_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, vector) of the usable rows; ``vector`` is null where a component is beyond ``MOST``."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    near = F.forall(x, lambda v: (scale * v < MOST) & (scale * v >= 1 - MOST))
    whole = F.when(near, F.transform(x, lambda v: F.floor(scale * v).cast("long")))
    return vectors.where((F.size(x) == size) & finite).select("vec_id", whole.alias("vector"))


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64,
            scale: int = 1024, seed: str = "3") -> tuple[DataFrame, DataFrame]:
    """Per vector (vec_id, cluster, distance), and per cluster (cluster, centroid, cluster_inertia).

    Centroids start as the ``k`` vectors of smallest lowercase-hex sha256 of ``<seed>:<vec_id>``.
    """
    if size > MAX_SIZE:
        raise ValueError(f"exact distances need at most {MAX_SIZE} components")
    stages = Stages(spark, "threshold-centroids")
    rows = stages.write("vectors", whole_vectors(vectors, size, scale))
    placed = rows.where(F.col("vector").isNotNull())
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = placed.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.array([r["vector"] for r in start], np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        summed = placed.mapInArrow(summer(centroids), SUMS).select(
            "cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        for c, at, n, value in summed.collect():  # centroids times dimensions
            centroids[c, at] = int(value) // n
    if not len(centroids):
        placed = placed.where("false")
    assigned = stages.write("assigned", placed.mapInArrow(assigner(centroids), ASSIGNED).unionByName(
        rows.where(F.col("vector").isNull()).select(
            "vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))))
    inertia = {c: int(v) for c, v in assigned.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row per centroid
    table = spark.createDataFrame(
        [(c, list(map(int, v)), inertia.get(c, 0)) for c, v in enumerate(centroids)],
        "cluster int, centroid array<long>, cluster_inertia long")
    return assigned, table


def digest(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and the sha256 of its centroid."""
    rows = centroids.collect()  # one per centroid
    total = sum(r["cluster_inertia"] for r in rows)
    facts = assigned.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"],
          hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in rows],
        "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"),
        "centroid_sha256")
