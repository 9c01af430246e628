"""Exact range join of unit vectors in a metric space, for near-duplicate embeddings.

Vectors of one label meet when their cosine reaches the threshold, which on the unit sphere is a
Euclidean range ``r``. Equal vectors are one point with a multiplicity. Pivots, a bounded hash sample
of the points of a label (one per ``CELL_POINTS``), cut space into cells of nearest pivots. A point
u in cell i has a partner in cell j only if |d(u,j) - d(u,i)| <= 2r by the triangle inequality, and,
as the border between two cells is a hyperplane, only if it lies within r of that, which cuts more;
it is then copied to j. Cells join independently: own points against own and copied ones. A cell
of many points is split into blocks of own points by blocks of partners, so that no task holds it
whole. Within a block only the number of partners, and a spanning forest of the links, come out.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
label, link with nothing and are their own component; vectors of different lengths never meet; equal
rows link like others; an empty table gives an empty result; other columns are ignored. Rows with a
null id are not vectors of the result's key and are returned unlinked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks.llm.common import Stages
from moundworks.llm.components import components

CELL_POINTS = 2_000
BLOCK_POINTS = 8_000
#: Pivots of one label at most; beyond it cells are larger and are split into blocks.
MAX_PIVOTS = 4_096
#: Widens the borders for rounding in distances; pairs are decided by the cosine itself.
SLACK = 1e-6


def usable(vector: str = "embedding"):
    """Vectors with finite components only, at least one of them not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # lengths of tiny or huge vectors stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_assigner(reach: float):
    """For a batch of one (label, length): own cell and the cells to copy to, of every point."""
    def assign(points: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = {"label": [], "size": [], "cell": [], "point": [], "n": [], "own": [], "vector": []}
        frame = pd.DataFrame(out)
        if points.empty:
            return frame
        p = _unit(pivots["vector"])
        apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
        frames = []
        for a in range(0, len(points), 4_096):
            some = points.iloc[a:a + 4_096]
            u = _unit(some["vector"])
            square = np.maximum(2 - 2 * u @ p.T, 0)
            own = square.argmin(1)
            nearest = square[np.arange(len(u)), own][:, None]
            gap = apart[own]
            plane = (square - nearest) <= 2 * gap * (reach + SLACK) + SLACK  # pivots of one direction have no gap
            triangle = np.sqrt(square) - np.sqrt(nearest) <= 2 * (reach + SLACK)
            row, cell = np.nonzero(plane & triangle)
            rows = some.iloc[row]
            frames.append(pd.DataFrame({
                "label": rows["label"].to_numpy(), "size": rows["size"].to_numpy(), "cell": cell,
                "point": rows["point"].to_numpy(), "n": rows["n"].to_numpy(),
                "own": cell == own[row], "vector": rows["vector"].to_numpy()}))
        return pd.concat(frames)
    return assign


ASSIGNED = "label int, size int, cell int, point long, n long, own boolean, vector"


def _forest(near: np.ndarray, group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (row, column) that join what all links of ``near`` join; ``group`` is updated."""
    for i in np.flatnonzero(near.any(1)).tolist():
        columns = np.flatnonzero(near[i])
        groups, first = np.unique(group[columns], return_index=True)
        for c in columns[first].tolist():
            yield i, c
        if len(groups) > 1:
            group[np.isin(group, groups[1:])] = groups[0]


def block_joiner(threshold: float):
    """Partners of each own point in one block of a cell: their number and a forest of the links."""
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        asks, other = rows[rows["asks"]], rows[~rows["asks"]]
        found = {"u": [], "v": [], "n_links": []}
        if len(asks) and len(other):
            unit, ids, n = _unit(other["vector"]), other["point"].to_numpy(), other["n"].to_numpy()
            group = np.arange(len(ids))
            for a in range(0, len(asks), 1_024):
                some = asks.iloc[a:a + 1_024]
                own = some["point"].to_numpy()
                near = _unit(some["vector"]) @ unit.T >= threshold
                near &= own[:, None] != ids[None, :]
                sums = near @ n
                linked = np.flatnonzero(sums)
                found["u"] += own[linked].tolist()
                found["v"] += [None] * len(linked)
                found["n_links"] += sums[linked].tolist()
                for i, j in _forest(near, group):
                    found["u"].append(int(own[i]))
                    found["v"].append(int(ids[j]))
                    found["n_links"].append(0)
        return pd.DataFrame({"u": pd.array(found["u"], "Int64"), "v": pd.array(found["v"], "Int64"),
                             "n_links": pd.array(found["n_links"], "Int64")})
    return join


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.98,
                 cell_points: int = CELL_POINTS, block_points: int = BLOCK_POINTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    stages = Stages(spark, "metric-join")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"),
                          F.col("embedding").alias("vector"))
    kind = dict(rows.dtypes)["vector"]
    linkable = usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("vector", F.when(linkable, F.col("vector")))
    rows = stages.write("rows", rows.select(
        "vec_id", "label", "vector", F.size("vector").alias("size"),
        F.when(linkable, F.sha2(F.to_json(F.struct("vector")), 256)).alias("same")))
    # all copies of a vector are one point
    points = stages.write("points", rows.where("same is not null").groupBy("label", "size", "same").agg(
        F.min("vec_id").alias("point"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    labels = points.groupBy("label", "size").agg(F.count("*").alias("points"))
    chosen = points.join(labels, ["label", "size"]).withColumn(
        "pivots", F.least(F.ceil(F.col("points") / cell_points), F.lit(MAX_PIVOTS)))
    # about twice the pivots by hash, then the first of them: a bounded window
    place = F.pmod(F.xxhash64("same"), F.col("points"))
    few = chosen.where(place < 2 * F.col("pivots") + 16)
    order = W.partitionBy("label", "size").orderBy(F.xxhash64("same"), "point")
    pivots = few.withColumn("rank", F.row_number().over(order)).where("rank <= pivots").select(
        "label", "size", "vector")
    pivots = stages.write("pivots", pivots)
    # a label's points are assigned in slices, each beside all of its pivots
    slices = F.ceil(F.col("points") / 50_000)
    sliced = points.join(labels, ["label", "size"]).withColumn(
        "slice", F.pmod(F.xxhash64("point"), slices))
    counts = labels.select("label", "size", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    assigned = sliced.groupBy("label", "size", "slice").cogroup(
        pivots.join(counts, ["label", "size"]).groupBy("label", "size", "slice")).applyInPandas(
        cell_assigner(reach), f"{ASSIGNED} {kind}")
    assigned = stages.write("cells", assigned)
    cell = ["label", "size", "cell"]
    sizes = assigned.groupBy(*cell).agg(
        F.ceil(F.sum(F.col("own").cast("int")) / block_points).alias("own_blocks"),
        F.ceil(F.count("*") / block_points).alias("blocks"))
    placed = assigned.join(sizes.where("own_blocks > 0"), cell)
    block = F.xxhash64("point")
    asks = placed.where("own").select(
        *cell, "point", "n", "vector", F.lit(True).alias("asks"),
        F.pmod(block, "own_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    other = placed.select(
        *cell, "point", "n", "vector", F.lit(False).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("i"), F.pmod(block, "blocks").alias("j"))
    found = stages.write("found", asks.unionByName(other).groupBy(*cell, "i", "j").applyInPandas(
        block_joiner(threshold), "u long, v long, n_links long"))
    linked = components(found.where("v is not null").select("u", "v"), stages)
    partners = found.where("v is null").groupBy("u").agg(F.sum("n_links").alias("others"))
    groups = points.select("label", "size", "same", "point", "n").join(
        partners, F.col("point") == F.col("u"), "left").join(
        linked, F.col("point") == F.col("node"), "left").select(
        "label", "size", "same",
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "point").alias("component_id"))
    joined = rows.select("vec_id", "label", "size", "same").join(groups, ["label", "size", "same"], "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
