"""Random forests of many groups, grown level by level from sums per node, feature and bin.

Rows are turned into bytes once, before they are dealt to parts of one group or some small ones: the bin of
every feature, the label as a whole number and a seed. Then each level is one job for the trees of all groups:
a task walks the rows of a part down the trees grown so far and adds up weights and labels per node, feature
and bin; a shuffle by group and tree merges these sums, and the best split of every open node comes back. Of
two siblings only the lighter is counted, the other is its parent less it. Memory and shuffled rows depend on
trees and nodes, not on the number of rows.

A row's weight in a tree is a Poisson(1) draw from a hash of the row, its occurrence among equal rows and
the tree; labels are whole numbers whose sums stay below 2^53. So all sums are exact, and the same rows
give the same forest in any order, on any number of cores.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from moundworks.operators.forest_walk import COLUMN_ROWS, COLUMN_STEPS, first_paths, stepped_down
from moundworks.storage import _exists, _hadoop_fs, _hadoop_path, settings, shared_dir

BLOCK_ROWS = 1 << 17
#: Rows of a part from which on there are two or three for a core.
PART_ROWS = 250_000
#: Rows whose seeds are mixed at a time.
MIXED_ROWS = 1 << 14
#: Bins up to which two features are added up at a time.
JOINT_BINS = 64
#: Distinct rows of a group that split candidates are taken from; Spark ML takes 10,000 rows.
CANDIDATE_ROWS = 100_000
#: Sums a task holds at a time; more open nodes than fit are taken in several jobs of fewer trees.
SUMS_BYTES = 256 << 20
#: Groups whose forests grow together.
GROUPS_AT_ONCE = 32
#: Rows of megabytes, and a task per file.
BLOCK_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.files.maxPartitionBytes": "1g",
                  "spark.sql.files.openCostInBytes": "1g"}
BLOCKS = "group int, n int, codes binary, labels binary, seeds binary"
STEP = 0x9E3779B97F4A7C15
#: Poisson(1) by 16 random bits
POISSON = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]),
                          (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass
class Group:
    """What a group's rows need to become bytes; ``index`` is its number, ``distinct`` counts its distinct rows."""
    index: int
    rows: int
    distinct: int
    low: float
    high: float
    cuts: list[np.ndarray] = field(default_factory=list)

    @property
    def scale(self) -> float:
        """Labels times this are whole numbers; eight times their number still add up exactly."""
        bits = max(min(40, 53 - math.ceil(math.log2(8 * self.rows))), 8)
        return (1 << bits) / (self.high - self.low) if self.high > self.low else 1.0


@dataclass
class Tree:
    """Growing nodes: the feature and bin they split at (rows up to that bin go left), children, value.

    A leaf is its own child. ``open`` lists the nodes of the last level that may still be split, ``counted``
    those whose rows are added up for it. ``source`` has for each open node its place in ``counted``, or its
    sibling's there and its parent's among the open nodes of the level above.
    """
    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    children: list[int] = field(default_factory=lambda: [0, 0])
    value: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    counted: list[int] = field(default_factory=lambda: [0])
    source: list[tuple[int, int]] = field(default_factory=lambda: [(0, -1)])

    def add(self, value: float) -> int:
        node = len(self.feature)
        self.feature.append(0)
        self.cut.append(0)
        self.children += [node, node]
        self.value.append(value)
        return node

    def walked_by(self, kind: str) -> tuple[np.ndarray, ...]:
        """Arrays a task walks by: feature, bin and left child of each node, the right one comes next. No bin is
        above a leaf's. The last array has the place of counted nodes, -1 for others."""
        place, left = np.full(len(self.feature), -1), np.array(self.children[::2])
        place[self.counted] = np.arange(len(self.counted))
        cut = np.where(left == np.arange(len(left)), np.iinfo(kind).max, self.cut).astype(kind)
        return np.array(self.feature), cut, left, place


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(seeds: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    salt, drawn = mixed(np.array([(seed * STEP + tree + 1) % (1 << 64)], np.uint64)), np.empty(len(seeds), np.uint8)
    for a in range(0, len(seeds), MIXED_ROWS):
        at = mixed(seeds[a:a + MIXED_ROWS] ^ salt)
        at >>= np.uint64(48)
        POISSON.take(at.view(np.int64), mode="clip", out=drawn[a:a + MIXED_ROWS])
    return drawn


def candidates(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds between values, at equal shares of the rows."""
    values, at = np.unique(values, return_inverse=True)
    upto = np.cumsum(np.bincount(at, counts, len(values)))
    if len(values) <= bins:
        left = np.arange(len(values) - 1)
    else:
        share = upto[-1] * np.arange(1, bins) / bins
        right = np.searchsorted(upto[:-1], share).clip(1, len(values) - 2)
        left = np.unique(np.where(share - upto[right - 1] < upto[right] - share, right - 1, right))
    low, high = values[left], values[left + 1]
    with np.errstate(invalid="ignore"):
        middle = low / 2 + high / 2
    return np.where((middle >= low) & (middle < high) & np.isfinite(middle), middle, low)


def row_hash(key: list[str], features: list[str], label: str) -> Column:
    return F.xxhash64(*key, *features, label)


def _cuts(rows: DataFrame, groups: dict[int, Group], features: list[str], bins: int) -> None:
    """Split candidates of every feature from a share of each group's distinct rows, by their hash."""
    steps = F.create_map(*[F.lit(v) for i, g in groups.items() for v in (i, max(1, g.distinct // CANDIDATE_ROWS))])
    taken = rows.where(F.pmod("hash", F.element_at(steps, F.col("group"))) == 0)
    kinds = taken.groupBy("group", "hash").agg(*[F.first(f).alias(f) for f in features], F.count("*").alias("n"))

    def cut(table: pa.Table) -> pa.Table:
        counts = table.column("n").to_numpy()
        found = [candidates(table.column(f).to_numpy(), counts, bins).tolist() for f in features]
        return pa.table({"group": pa.array([table.column("group")[0].as_py()] * len(features), pa.int32()),
                         "feature": pa.array(range(len(features)), pa.int32()),
                         "cuts": pa.array(found, pa.list_(pa.float64()))})

    for row in kinds.groupBy("group").applyInArrow(cut, "group int, feature int, cuts array<double>").orderBy(
            "group", "feature").collect():  # bins times features of a group
        groups[row["group"]].cuts.append(np.array(row["cuts"]))


def parts_of(groups: dict[int, Group], parallel: int) -> tuple[dict[int, tuple[int, int]], int]:
    """The first part of each group and how many its rows are dealt to, in proportion to rows, and the number of
    all parts. Small groups share parts; each part is a task of every level, which sends sums of all trees."""
    total = sum(g.rows for g in groups.values())
    wanted = max(1, min(total // 10_000, parallel * max(1, min(3, total // (PART_ROWS * parallel)))))
    exact = {i: g.rows * wanted / total for i, g in groups.items()}
    own = {i: int(x) for i, x in exact.items()}
    for i in sorted(groups, key=lambda i: (own[i] - exact[i], i))[:wanted - sum(own.values())]:
        own[i] += exact[i] >= 0.5
    parts, n, shared, held = {}, 0, 0, math.inf
    for i, g in groups.items():
        if own[i]:
            parts[i], n = (n, own[i]), n + own[i]
            continue
        if held + g.rows > total / wanted:
            shared, held, n = n, 0, n + 1
        parts[i], held = (shared, 1), held + g.rows
    return parts, n


def coded(batches: Iterator[pa.RecordBatch], groups: dict[int, Group], features: list[str], label: str,
          kind: str) -> Iterator[pa.RecordBatch]:
    """Rows with the bins of their features as bytes and their label as a whole number."""
    for batch in batches:
        of, values = batch.column("group").to_numpy(), [batch.column(f).to_numpy() for f in features]
        codes, labels = np.empty((len(of), len(features)), kind), batch.column(label).to_numpy().copy()
        for i in np.unique(of).tolist():
            g, here = groups[i], np.flatnonzero(of == i)
            for j, cuts in enumerate(g.cuts):
                codes[here, j] = np.searchsorted(cuts, values[j][here])
            labels[here] = np.rint((labels[here] - g.low) * g.scale)
        width = codes.itemsize * len(features)
        edges = pa.py_buffer(np.arange(0, len(of) * width + 1, width, np.int32))
        yield pa.RecordBatch.from_pydict({
            "group": batch.column("group"), "hash": batch.column("hash"), "label": pa.array(labels),
            "codes": pa.Array.from_buffers(pa.binary(), len(of), [None, edges, pa.py_buffer(codes.tobytes())])})


def blocks_of(batches: Iterator[pa.RecordBatch], n_features: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows in the order of group and hash, as blocks of one group each."""
    last, occurrence, held, size = None, 0, [], 0

    def block(group: int) -> pa.RecordBatch:
        codes, labels, seeds = (np.concatenate(x, -1) for x in zip(*held))
        held.clear()
        return pa.RecordBatch.from_pydict({
            "group": pa.array([group], pa.int32()), "n": pa.array([len(seeds)], pa.int32()),
            "codes": [codes.tobytes()], "labels": [labels.tobytes()], "seeds": [seeds.tobytes()]})

    for batch in batches:
        if not batch.num_rows:
            continue
        of, hashes, labels = (batch.column(c).to_numpy() for c in ("group", "hash", "label"))
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind).reshape(len(of), n_features)
        new = np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])]
        starts = np.flatnonzero(new)
        nth = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        if (of[0], hashes[0]) == last:
            run = starts[1] if len(starts) > 1 else len(of)
            nth[:run] += occurrence + 1
        group_edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
        for a, b in zip(group_edges, group_edges[1:]):
            if held and (of[a] != last[0] or size + b - a > BLOCK_ROWS):
                yield block(int(last[0]))
                size = 0
            seeds = mixed(hashes[a:b].view(np.uint64) + nth[a:b].astype(np.uint64) * np.uint64(STEP))
            held.append((codes[a:b].T, labels[a:b], seeds))
            size, last, occurrence = size + b - a, (of[b - 1], hashes[b - 1]), int(nth[b - 1])
    if held:
        yield block(int(last[0]))


def joint_codes(codes: np.ndarray, bins: int) -> list[tuple[int, np.ndarray, bool]]:
    """Features two by two as one code, the last one alone if their number is odd: (first feature, codes, two)."""
    if bins > JOINT_BINS:
        return []
    pairs = [(j, codes[j].astype(np.uint16) * np.uint16(bins) + codes[j + 1], True) for j in range(0, len(codes) - 1, 2)]
    return pairs + [(len(codes) - 1, codes[-1], False)] * (len(codes) % 2)


def add_up(found: np.ndarray, node: np.ndarray, at: np.ndarray, codes: np.ndarray,
           joint: list[tuple[int, np.ndarray, bool]], values: tuple[np.ndarray, ...], bins: int) -> None:
    """Add ``values`` of the rows ``at`` to the sums per value, feature, place of their node and bin.

    Where rows are many for it, they are added up by the bins of two features and these sums by each of them.
    """
    places = found.shape[2]
    if not joint or len(at) < places * bins * bins:
        joint = [(j, codes[j], False) for j in range(len(codes))]
    starts = {two: node * (bins * bins if two else bins) for two in {two for *_, two in joint}}
    for j, of, two in joint:
        where = starts[two] + of.take(at, mode="clip")
        for total, value in zip(found, values):
            if two:
                sums = np.bincount(where, value, places * bins * bins).reshape(places, bins, bins)
                total[j] += sums.sum(2)
                total[j + 1] += sums.sum(1)
            else:
                total[j] += np.bincount(where, value, places * bins).reshape(places, bins)


def drawn_rows(codes: np.ndarray, by_row: np.ndarray, weight: np.ndarray, tree: tuple[np.ndarray, ...],
               level: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of positive weight in counted nodes, and the places of these."""
    *walk, place = tree
    if level <= COLUMN_STEPS:  # a byte tells where a row is
        where, at = np.empty(len(weight), np.uint8), np.empty(len(weight), bool)
        for a in range(0, len(weight), COLUMN_ROWS):
            b = a + COLUMN_ROWS
            turns, ends = first_paths(codes[:, a:b], *walk, level)
            places = np.full(256, 255, np.uint8)
            places[:len(ends)] = place[ends] % 256
            where[a:b] = np.frombuffer(turns.tobytes().translate(places.tobytes()), np.uint8)
            np.logical_and(weight[a:b], where[a:b] != 255, out=at[a:b])
        at = np.flatnonzero(at)
        return at, where.take(at, mode="clip").astype(np.int64)
    at, turns = np.flatnonzero(weight > 0), np.empty(len(weight), np.uint8)
    for a in range(0, len(weight), COLUMN_ROWS):
        turns[a:a + COLUMN_ROWS], ends = first_paths(codes[:, a:a + COLUMN_ROWS], *walk, COLUMN_STEPS)
    node = ends.take(turns.take(at, mode="clip"))
    node = place.take(stepped_down(by_row, at * len(codes), node, *walk, level - COLUMN_STEPS), mode="clip")
    here = np.flatnonzero(node >= 0)
    return at.take(here, mode="clip"), node.take(here, mode="clip")


def level_sums(batches: Iterator[pa.RecordBatch], trees: dict[int, dict[int, tuple]], level: int, n_features: int,
               bins: int, kind: str, seed: int) -> Iterator[pa.RecordBatch]:
    """Weights and weighted labels per counted node, feature and bin of each tree, over the rows of a task."""
    group, sums = None, {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for tree in list(sums):
            yield pa.RecordBatch.from_pydict({"group": pa.array([group], pa.int32()), "tree": pa.array([tree], pa.int32()),
                                              "sums": [sums.pop(tree).tobytes()]})

    for batch in batches:
        for row in batch.to_pylist():
            if row["group"] != group:
                yield from flushed()
                group = row["group"]
            codes = np.frombuffer(row["codes"], kind).reshape(n_features, row["n"])
            labels, seeds = np.frombuffer(row["labels"]), np.frombuffer(row["seeds"], np.uint64)
            joint, by_row = joint_codes(codes, bins), codes.T.ravel()
            for tree, walk in trees[group].items():
                weight = weights(seeds, tree, seed)
                at, node = drawn_rows(codes, by_row, weight, walk, level)
                weight = weight.take(at, mode="clip").astype(np.float64)
                if tree not in sums:
                    sums[tree] = np.zeros((2, n_features, walk[-1].max() + 1, bins))
                add_up(sums[tree], node, at, codes, joint, (weight, labels.take(at, mode="clip") * weight), bins)
    yield from flushed()


def best_splits(found: np.ndarray, min_leaf: int) -> np.ndarray:
    """Per open node: feature (-1: none) and bin of the split that lowers the variance most, the weight and the
    label sum on its left, and those of the node. ``found`` has weights and labels by feature, node and bin."""
    (weight, label), bins = found, found.shape[-1]
    whole, total = weight[0].sum(-1), label[0].sum(-1)
    left, below = weight.cumsum(-1)[..., :-1], label.cumsum(-1)[..., :-1]
    right = whole[:, None] - left
    least = max(min_leaf, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = total[:, None] * left / whole[:, None]
        apart = below - share
        apart[np.abs(apart) <= 1e-13 * np.abs(share)] = 0  # the rounding of equal means
        gain = np.where((left >= least) & (right >= least), apart * apart * whole[:, None] / (left * right), 0)
    gain = gain.transpose(1, 0, 2).reshape(len(whole), -1)
    best, nodes = gain.argmax(1), np.arange(len(whole))
    feature, cut = np.divmod(best, bins - 1)
    return np.stack([np.where(gain[nodes, best] > 0, feature, -1), cut, left[feature, nodes, cut],
                     below[feature, nodes, cut], whole, total]).astype(np.float64)


def merged_splits(batches: Iterator[pa.RecordBatch], sources: dict[int, dict[int, np.ndarray]], n_features: int,
                  bins: int, min_leaf: int) -> Iterator[pa.RecordBatch]:
    """Splits and sums of open nodes from the sums of all tasks and those of the level above (``upper``); a
    partition holds every row of its trees."""
    sums: dict[tuple[int, int, bool], np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            key, found = (row["group"], row["tree"], row["upper"]), np.frombuffer(row["sums"])
            sums[key] = sums[key] + found if key in sums else found
    for group, tree, upper in sorted(sums):
        if upper:
            continue
        counted, above = sources[group][tree].T
        found = sums.pop((group, tree, False)).reshape(2, n_features, -1, bins)[:, :, counted]
        if (above >= 0).any():
            parents = sums.pop((group, tree, True)).reshape(2, n_features, -1, bins)
            found[:, :, above >= 0] = parents[:, :, above[above >= 0]] - found[:, :, above >= 0]
        yield pa.RecordBatch.from_pydict({
            "group": pa.array([group], pa.int32()), "tree": pa.array([tree], pa.int32()),
            "splits": [best_splits(found, min_leaf).tobytes()], "sums": [found.tobytes()]})


def _grow(tree: Tree, splits: np.ndarray, group: Group, min_leaf: int, deeper: bool, last: bool) -> None:
    """Add the children of the open nodes; those that may be split are open next."""
    def value(label: float, weight: float) -> float:
        return group.low + label / weight / group.scale if weight else (group.low + group.high) / 2

    before, tree.open, tree.counted, tree.source = tree.open, [], [], []
    for i, (node, (feature, cut, left, below, whole, total)) in enumerate(zip(before, splits.T.tolist())):
        if node == 0:
            tree.value[0] = value(total, whole)
        if feature < 0 or not deeper:
            continue
        sides = ((left, below), (whole - left, total - below))
        children = [tree.add(value(label, weight)) for weight, label in sides]
        tree.feature[node], tree.cut[node] = int(feature), int(cut)
        tree.children[2 * node:2 * node + 2] = children
        opened = [] if last else [c for c, (weight, _) in zip(children, sides) if weight >= 2 * max(min_leaf, 1)]
        if opened:
            light = children[0] if left <= whole - left else children[1]
            tree.open += opened
            tree.source += [(len(tree.counted), -1 if child == light else i) for child in opened]
            tree.counted.append(light)


def _nodes(trees: list[Tree], group: Group) -> list[tuple]:
    """The form ``forest_walk.flattened`` reads."""
    out = []
    for t, tree in enumerate(trees):
        for node, value in enumerate(tree.value):
            low, high = tree.children[2 * node:2 * node + 2]
            split = low != node
            feature, cut = tree.feature[node], tree.cut[node]
            out.append((t, node, value, *((low, high, feature, float(group.cuts[feature][cut])) if split else (-1, -1, -1, 0.0))))
    return out


def _jobs(forests: dict[int, list[Tree]], node_bytes: int) -> Iterator[range]:
    """Ranges of trees whose counted nodes' sums fit a task, whichever group it reads."""
    start, held = 0, dict.fromkeys(forests, 0)
    n_trees = len(next(iter(forests.values())))
    for t in range(n_trees):
        need = {g: held[g] + len(trees[t].counted) * node_bytes for g, trees in forests.items()}
        if t > start and max(need.values()) > SUMS_BYTES:
            yield range(start, t)
            start, need = t, {g: len(trees[t].counted) * node_bytes for g, trees in forests.items()}
        held = need
    yield range(start, n_trees)


def _grown(blocks: DataFrame, folder: str, groups: dict[int, Group], n_features: int, trees: int, depth: int,
           min_leaf: int, bins: int, kind: str, seed: int) -> dict[int, list[Tree]]:
    """Trees of some groups; the sums of each level lie in ``folder`` until the next is done."""
    spark = blocks.sparkSession
    forests, above = {i: [Tree() for _ in range(trees)] for i in groups}, None
    for level in range(max(depth, 1)):
        done = f"{folder}/level-{min(groups)}-{level}"
        for job in _jobs(forests, 16 * n_features * bins):
            wanted = {i: {t: forest[t] for t in job if forest[t].open} for i, forest in forests.items()}
            wanted = {i: found for i, found in wanted.items() if found}
            if not wanted:
                continue
            grown = spark.sparkContext.broadcast({i: {t: tree.walked_by(kind) for t, tree in w.items()} for i, w in wanted.items()})
            sources = spark.sparkContext.broadcast({i: {t: np.array(tree.source) for t, tree in w.items()} for i, w in wanted.items()})
            sums = blocks.where(F.col("group").isin(list(wanted))).mapInArrow(
                lambda batches: level_sums(batches, grown.value, level, n_features, bins, kind, seed),
                "group int, tree int, sums binary").withColumn("upper", F.lit(False))
            if above is not None:
                sums = sums.unionByName(above.where(F.col("tree").between(job[0], job[-1])).withColumn("upper", F.lit(True)))
            parts = max(spark.sparkContext.defaultParallelism, sum(map(len, wanted.values())) // 32)
            sums.repartition(parts, "group", "tree").mapInArrow(
                lambda batches: merged_splits(batches, sources.value, n_features, bins, min_leaf),
                "group int, tree int, splits binary, sums binary").write.mode("append").parquet(done)
            grown.unpersist()
            sources.unpersist()
        if not _exists(spark, done):
            break
        table = spark.read.schema("group int, tree int, splits binary, sums binary").parquet(done)
        for i, t, found in table.select("group", "tree", "splits").collect():  # six numbers per open node
            _grow(forests[i][t], np.frombuffer(found).reshape(6, -1), groups[i], min_leaf, depth > 0, level + 1 >= depth)
        above = table.select("group", "tree", "sums")
    return forests


def group_number(group: str, values: dict, of_type: DataType) -> Column:
    """The number of a row's group; ``values`` has the ``Group`` of each value."""
    numbers = [x for v, g in values.items() for x in (F.lit(v).cast(of_type), F.lit(g.index))]
    return F.element_at(F.create_map(*numbers), F.col(group))


def grow_forests(matrix: DataFrame, group: str, values: dict, features: list[str], label: str, key: list[str], *,
                 trees: int, depth: int, min_leaf: int, bins: int, seed: int) -> dict:
    """The nodes of a forest per value of ``group``; ``values`` has the ``Group`` of each, by its number in order.

    Rows are bytes before they are dealt out; equal ones come to one part, and a part has few groups.
    """
    spark = matrix.sparkSession
    rows = matrix.select(
        group_number(group, values, matrix.schema[group].dataType).alias("group"), row_hash(key, features, label).alias("hash"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))
    names, groups = [f"x{i}" for i in range(len(features))], {g.index: g for g in values.values()}
    kind = "u1" if bins <= 256 else "<u4"
    _cuts(rows, groups, names, bins)
    parts, n_parts = parts_of(groups, spark.sparkContext.defaultParallelism)
    folder = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    told, n_features = spark.sparkContext.broadcast(groups), len(features)
    first, among = (F.element_at(F.create_map(*[F.lit(x) for i, p in parts.items() for x in (i, p[k])]), F.col("group"))
                    for k in (0, 1))
    rows.mapInArrow(
        lambda batches: coded(batches, told.value, names, "y", kind), "group int, hash long, label double, codes binary"
    ).repartitionById(n_parts, (first + F.pmod("hash", among)).cast("int")).sortWithinPartitions("group", "hash").mapInArrow(
        lambda batches: blocks_of(batches, n_features, kind), BLOCKS).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    nodes, order = {}, list(values)
    with settings(spark, BLOCK_SETTINGS):
        for a in range(0, len(order), GROUPS_AT_ONCE):
            some = {values[v].index: values[v] for v in order[a:a + GROUPS_AT_ONCE]}
            forests = _grown(blocks, folder, some, n_features, trees, depth, min_leaf, bins, kind, seed)
            nodes |= {v: _nodes(forests[values[v].index], values[v]) for v in order[a:a + GROUPS_AT_ONCE]}
    _hadoop_fs(spark, folder).delete(_hadoop_path(spark, folder), True)
    return nodes
