"""Predictions of a trained forest under several views of its features, in one walk over the rows.

A view keeps some features and holds the others at fixed values. Splits on a fixed feature always go one
way, so each view gets its own trees without them. A row's features become codes once, the number of the
forest's thresholds below each; a block of rows steps down one tree after the other. A view whose trees
tell few combinations of codes apart walks down for each combination once.
The arrays are read from the forest's stored form; their size depends on trees and depth alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.storage import _hadoop_fs, _hadoop_path, shared_dir

BLOCK_ROWS = 1 << 15
#: Rows of all groups gathered before they are walked.
GATHERED_ROWS = 1 << 17
#: Combinations of codes up to which a view keeps the prediction of each.
KEPT_CELLS = 1 << 17
#: Steps taken by comparing whole columns; their nodes double with every step.
COLUMN_STEPS = 5
COLUMN_ROWS = 1 << 16


def first_paths(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray,
                steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The turns of each row in at most eight steps, a bit per step, and the node at the end of each path.

    ``codes`` has a row per feature. The right child comes next to the left one; a leaf is its own left child,
    and no code is above its cut, so paths turn left there.
    """
    last = np.iinfo(cut.dtype).max
    ends = np.zeros(1, np.int64)
    for _ in range(steps):
        ends = np.stack([left[ends], left[ends] + (cut[ends] < last)], 1).ravel()
    if not steps:
        return np.zeros(codes.shape[1], np.uint8), ends

    features, cuts, lefts = feature.tolist(), cut.tolist(), left.tolist()

    def turns(node: int, bit: int) -> np.ndarray:
        if cuts[node] == last:
            return np.zeros(codes.shape[1], np.uint8)
        right = np.greater(codes[features[node]], cut[node]).view(np.uint8)
        if bit == 1:
            return right
        low, high = turns(lefts[node], bit >> 1), turns(lefts[node] + 1, bit >> 1)
        np.bitwise_or(high, bits[bit], out=high)
        np.bitwise_xor(high, low, out=high)
        np.bitwise_and(high, np.negative(right, out=right), out=high)
        return np.bitwise_xor(high, low, out=high)

    bits = {1 << i: np.uint8(1 << i) for i in range(steps)}
    return turns(0, 1 << (steps - 1)), ends


def stepped_down(codes: np.ndarray, starts: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray,
                 left: np.ndarray, steps: int) -> np.ndarray:
    """The node of each row some steps further; ``starts`` has the place of its first code.

    Indices are clipped, which is faster than looking for those out of bounds; there are none.
    """
    for _ in range(steps):
        at = feature.take(node, mode="clip")
        at += starts
        right = codes.take(at, mode="clip") > cut.take(node, mode="clip")
        node = left.take(node, mode="clip")
        node += right
    return node


@dataclass
class FlatForest:
    """Nodes of all views, tree by tree: feature, the place of the threshold among its ``cuts``, left child
    (counted from the tree's first node) and value.

    ``starts`` and ``depths`` have a row per view and a column per tree; ``kept`` has the predictions of a
    view by combination of codes.
    """
    views: list[str]
    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    starts: np.ndarray
    depths: np.ndarray
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """(rows, views): the mean of the trees, added in their order."""
        codes = np.stack([np.searchsorted(c, rows[:, i]) for i, c in enumerate(self.cuts)]).astype(self.cut.dtype)
        return np.stack([self._of_view(v, codes) for v in range(len(self.views))], 1)

    def _of_view(self, view: int, codes: np.ndarray) -> np.ndarray:
        if view not in self.kept:
            self.kept[view] = self._cells(view)
        radix, found = self.kept[view]
        if not len(found):
            return self._walked(view, codes)
        cell = radix @ codes
        new, at = np.unique(cell, return_index=True)
        at = at[np.isnan(found[new])]
        if len(at):
            found[cell[at]] = self._walked(view, codes[:, at])
        return found[cell]

    def _cells(self, view: int) -> tuple[np.ndarray, np.ndarray]:
        """Radix of each feature's code and a prediction per combination of codes, none where they are many."""
        radix, cells = np.zeros(len(self.cuts), np.int64), 1
        nodes = slice(self.starts[view, 0], self.starts[view, -1])
        for f in np.unique(self.feature[nodes][self.cut[nodes] < np.iinfo(self.cut.dtype).max]).tolist():
            radix[f], cells = cells, cells * (len(self.cuts[f]) + 1)
            if cells > KEPT_CELLS:
                return radix, np.empty(0)
        return radix, np.full(cells, np.nan)

    def _walked(self, view: int, codes: np.ndarray) -> np.ndarray:
        total, edges, depths = np.zeros(codes.shape[1]), self.starts[view], self.depths[view]
        by_row, starts = codes.T.ravel(), np.arange(0, codes.size, len(codes))
        for a, b, depth in zip(edges, edges[1:], depths):
            tree, first = (self.feature[a:b].astype(np.int64), self.cut[a:b], self.left[a:b].astype(np.int64)), min(depth, COLUMN_STEPS)
            turns, ends = first_paths(codes, *tree, first)
            node = stepped_down(by_row, starts, ends.take(turns), *tree, depth - first)
            total += self.value[a:b].take(node)
        return total / len(depths)


def stored_nodes(spark: SparkSession, model: RandomForestRegressionModel) -> list[tuple]:
    """(tree, id, value, left, right, feature, threshold) of every node."""
    folder = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(folder)
    node, split = F.col("nodeData"), F.col("nodeData.split")
    rows = spark.read.parquet(f"{folder}/data").select(
        "treeID", node["id"], node["prediction"], node["leftChild"], node["rightChild"], split["featureIndex"],
        F.get(split["leftCategoriesOrThreshold"], 0)).collect()  # trees times two to the depth
    _hadoop_fs(spark, folder).delete(_hadoop_path(spark, folder), True)
    return [tuple(r) for r in rows]


def flattened(nodes: list[tuple], views: dict[str, set[int]], fixed: list[float]) -> FlatForest:
    """The trees under each view: ``views`` names the features it keeps, the others are ``fixed``."""
    trees: dict[int, dict[int, tuple]] = {}
    for tree, *node in nodes:
        trees.setdefault(tree, {})[node[0]] = node
    thresholds: list[set[float]] = [set() for _ in fixed]
    for tree, _, _, left, _, feature, threshold in nodes:
        if left >= 0:
            thresholds[feature].add(threshold)
    cuts = [np.array(sorted(t)) for t in thresholds]
    places = [{t: i for i, t in enumerate(c.tolist())} for c in cuts]
    kind = np.uint8 if max(map(len, cuts), default=0) < 256 else np.uint32
    flat: list[tuple] = []  # feature, cut, left, value

    def kept_node(tree: dict[int, tuple], i: int, kept: set[int]) -> tuple:
        node = tree[i]
        while node[2] >= 0 and node[4] not in kept:
            node = tree[node[2] if fixed[node[4]] <= node[5] else node[3]]
        return node

    def place(tree: dict[int, tuple], kept: set[int]) -> int:
        """Appends a tree, siblings next to each other, and returns its depth."""
        level, depth, size = [kept_node(tree, 0, kept)], 0, 1
        while level:
            below = []
            for at, (_, value, left, right, feature, threshold) in enumerate(level, size - len(level)):
                if left < 0:
                    flat.append((0, np.iinfo(kind).max, at, value))
                else:
                    flat.append((feature, places[feature][threshold], size + len(below), value))
                    below += [kept_node(tree, i, kept) for i in (left, right)]
            level, depth, size = below, depth + bool(below), size + len(below)
        return depth

    starts, depths = [], []
    for kept in views.values():
        starts.append([])
        depths.append([])
        for t in sorted(trees):
            starts[-1].append(len(flat))
            depths[-1].append(place(trees[t], kept))
        starts[-1].append(len(flat))
    feature, cut, left, value = zip(*flat)
    return FlatForest(list(views), cuts, np.array(feature, np.int32), np.array(cut).astype(kind), np.array(left, np.int32),
                      np.array(value), np.array(starts), np.array(depths))


def _predicted(forest: FlatForest, rows: np.ndarray) -> np.ndarray:
    blocks = [forest.predict(rows[a:a + BLOCK_ROWS]) for a in range(0, len(rows), BLOCK_ROWS)]
    return np.concatenate(blocks or [np.empty((0, len(forest.views)))])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of many rows from those of few."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > GATHERED_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def walked(df: DataFrame, features: list[str], forest: FlatForest) -> DataFrame:
    """Adds one column per view."""
    return walked_by_group(df, F.lit(0), features, {0: forest}, df.columns)


def walked_by_group(df: DataFrame, number: Column, features: list[str], forests: dict[int, FlatForest],
                    kept: list[str]) -> DataFrame:
    """The columns ``kept`` and one per view, from the forest that has a row's ``number``."""
    views = next(iter(forests.values())).views
    shared = {n: df.sparkSession.sparkContext.broadcast(forest) for n, forest in forests.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            rows = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float)
            of, found = batch.column(batch.num_columns - 1).to_numpy(), np.empty((batch.num_rows, len(views)))
            for n in np.unique(of).tolist():
                here = np.flatnonzero(of == n)
                found[here] = _predicted(shared[n].value, rows if len(here) == len(rows) else rows[here])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(c) for c in found.T.copy())], [*kept, *views])

    needed = list(dict.fromkeys([*kept, *features]))
    name = next(n for n in ("forest", *(f"forest_{i}" for i in range(len(needed)))) if n not in needed)
    kinds = ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in kept), *(f"`{v}` double" for v in views)])
    return df.select(*[f"`{n}`" for n in needed], number.alias(name)).mapInArrow(walk, kinds)
