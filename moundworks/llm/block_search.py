"""Nearest neighbours by a block matrix join with int8 tiles and exact verification.

Vectors are packed into blocks once, each with its doubles and its int8 form: unit vectors rounded to
int8, with a scale and the length of what rounding left over. A tile is one block of queries against
one of candidates. The join has two passes.

The first ships int8 only. The product of a tile gives every cosine up to a bound that the two rests
set, by Cauchy and Schwarz. A candidate row is wanted by a block of queries if its upper bound reaches
the k-th best lower bound of one of them so far; a tile puts out one bit per candidate row. The second
ships the doubles of wanted rows only. Pairs whose bounds survive are recomputed in double precision
and kept in a heap per query row; the heaps of all tasks are merged at the end. Nothing is approximate:
the bounds only spare work. No pass puts out pairs, so large groups of near copies cost no rows.

Queries reach a task once, ahead of its candidates: both are rows of one table, sorted that way. Blocks
of queries are dealt to as many parts of the candidates as keep all cores busy.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without
an id, take no part; only vectors of one length are compared; ties go to the smaller id; a row is not
its own candidate, and rows that repeat the query's id are not either; query rows that repeat id and
vector are one query, those of one id and several vectors have their neighbours each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks.llm.common import Stages
from moundworks.llm.metric_join import usable
from moundworks.storage import sized_lookup

NEIGHBOURS = 5
QUERY_BLOCK, CANDIDATE_BLOCK = 32_768, 8_192
#: Query rows of a tile that are compared at a time, which bounds a task's memory.
SLICE = 512
#: More than single precision can be off by in a bound; all terms are below two.
SLACK = 2e-6
ROUNDED = ("int8", "step", "rest", "length")
BLOCK = "size int, block string, ids binary, vectors binary, " + ", ".join(f"{c} binary" for c in ROUNDED)
FOUND = "q_block string, q_row int, query_id long, vec_id long, score double"


class Block:
    """Ids and int8 forms of vectors, and the vectors themselves if they are at hand."""

    def __init__(self, ids: np.ndarray, int8, step, rest, length, vectors: np.ndarray | None = None):
        self.ids, self.int8, self.vectors = ids, int8, vectors
        single = int8.shape[1] * 127 * 127 < 1 << 24  # such products are exact
        self.kind = np.float32 if single else np.float64
        self.step, self.rest, self.length = (x.astype(self.kind) for x in (step, rest, length))
        self.by_id = np.argsort(ids, kind="stable")

    @classmethod
    def of_vectors(cls, ids: np.ndarray, vectors: np.ndarray) -> Block:
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        step = np.abs(unit).max(1, keepdims=True) / 127
        rounded = np.rint(unit / step)
        return cls(ids, rounded.astype(np.int8), step[:, 0], np.linalg.norm(unit - rounded * step, axis=1),
                   np.linalg.norm(rounded * step, axis=1), vectors)

    @classmethod
    def of_row(cls, row: dict) -> Block:
        ids = np.frombuffer(row["ids"], "<i8")
        if row.get("vectors") is not None:
            return cls.of_vectors(ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1))
        return cls(ids, np.frombuffer(row["int8"], np.int8).reshape(len(ids), -1),
                   *(np.frombuffer(row[c], "<f4") for c in ROUNDED[1:]))

    def stored(self) -> dict[str, bytes]:
        """Single-precision terms; what that takes off them is within ``SLACK``."""
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": self.vectors.astype("<f8").tobytes(),
                "int8": self.int8.tobytes()} | {
                    c: getattr(self, c).astype("<f4").tobytes() for c in ROUNDED[1:]}


def block_packer(rows_per_block: int):
    """Packs rows of a partition, by vector length, into blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = defaultdict(list)
        part, count = TaskContext.get().partitionId(), 0

        def flush(size: int) -> pa.RecordBatch:
            nonlocal count
            rows, waiting[size] = waiting[size], []
            count += 1
            block = Block.of_vectors(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows]))
            named = {"size": pa.array([size], pa.int32()), "block": [f"{part}-{count}"]}
            return pa.RecordBatch.from_pydict(named | {
                c: pa.array([value], pa.binary()) for c, value in block.stored().items()})

        for batch in batches:
            for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
                vector = vector.values.to_numpy()
                waiting[len(vector)].append((vec_id, vector.copy()))
                if len(waiting[len(vector)]) == rows_per_block:
                    yield flush(len(vector))
        for size in [s for s, rows in waiting.items() if rows]:
            yield flush(size)
    return pack


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def tile_bounds(queries: Block, candidates: Block, a: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines of a slice of queries; both -inf for rows of one id."""
    some = slice(a, a + SLICE)
    near = queries.int8[some].astype(queries.kind) @ candidates.int8.astype(queries.kind).T
    near *= queries.step[some, None]
    near *= candidates.step
    off = (np.column_stack([queries.rest[some], queries.length[some]])
           @ np.stack([candidates.length + candidates.rest, candidates.rest])) + queries.kind(SLACK)
    first, last = (np.searchsorted(candidates.ids, queries.ids[some], side, candidates.by_id)
                   for side in ("left", "right"))
    for q in np.flatnonzero(last > first):
        near[q, candidates.by_id[first[q]:last[q]]] = -np.inf
    return near - off, near + off


def raised(best: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The k best values of each row of ``best`` and ``lower``, ascending; ``best`` has k columns."""
    k = best.shape[1]
    rows = np.flatnonzero((lower > best[:, :1]).any(1))
    if len(rows):
        found = lower[rows]
        if found.shape[1] > k:
            found = np.partition(found, found.shape[1] - k, axis=1)[:, -k:]
        best[rows] = np.sort(np.concatenate([best[rows], found], axis=1), axis=1)[:, -k:]
    return best


def wanted_rows(queries: Block, candidates: Block, best: np.ndarray) -> np.ndarray:
    """Which candidates may be among the k best of a query; raises the k best lower bounds so far."""
    wanted = np.zeros(len(candidates.ids), bool)
    for a in range(0, len(queries.ids), SLICE):
        lower, upper = tile_bounds(queries, candidates, a)
        floor = raised(best[a:a + SLICE], lower)[:, :1]
        wanted |= ((upper >= floor) & (upper > -np.inf)).any(0)
    return wanted


def tile_filter(k: int):
    """The first pass over the tiles of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = best = None
        for row in rows_of(batches):
            if not row["answer"]:
                queries = Block.of_row(row)
                best = np.full((len(queries.ids), k), -np.inf, queries.kind)
                continue
            bits = wanted_rows(queries, Block.of_row(row), best)
            if bits.any():
                yield pa.RecordBatch.from_pydict({
                    "q_block": [row["q_block"]], "block": [row["block"]],
                    "wanted": pa.array([np.packbits(bits).tobytes()], pa.binary())})
    return run


def wanted_picker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a block and the bits of the blocks of queries that ask for it, the rows each of them wants."""
    for row in rows_of(batches):
        ids = np.frombuffer(row["ids"], "<i8")
        vectors = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
        for ask in row["asks"]:
            bits = np.unpackbits(np.frombuffer(ask["wanted"], np.uint8), count=len(ids)).astype(bool)
            yield pa.RecordBatch.from_pydict({
                "q_block": [ask["q_block"]], "block": [row["block"]],
                "ids": pa.array([ids[bits].tobytes()], pa.binary()),
                "vectors": pa.array([vectors[bits].tobytes()], pa.binary())})


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row by itself, so equal rows give equal numbers."""
    a = a / np.abs(a).max(1, keepdims=True)
    b = b / np.abs(b).max(1, keepdims=True)
    dot = np.einsum("ij,ij->i", a, b)
    return dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def search_tile(queries: Block, candidates: Block, best: np.ndarray, heaps: dict) -> None:
    """Adds the survivors of one tile to the heaps, by query row: (score, -vec_id), smallest first."""
    k = best.shape[1]
    for a in range(0, len(queries.ids), SLICE):
        lower, upper = tile_bounds(queries, candidates, a)
        floor = raised(best[a:a + SLICE], lower)[:, :1]
        row, column = np.nonzero((upper >= floor) & (upper > -np.inf))
        for b in range(0, len(row), 65_536):
            i, j = row[b:b + 65_536] + a, column[b:b + 65_536]
            scores = cosine(queries.vectors[i], candidates.vectors[j])
            order = np.lexsort((candidates.ids[j], -scores, i))
            i, j, scores = i[order], j[order], scores[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < k
            for q, score, other in zip(i[top].tolist(), scores[top].tolist(), candidates.ids[j[top]].tolist()):
                heap = heaps[q]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -other))
                elif (score, -other) > heap[0]:
                    heapq.heapreplace(heap, (score, -other))


def tile_searcher(k: int):
    """The second pass over the tiles of a partition."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, queries, best, heaps = None, None, None, defaultdict(list)

        def flush() -> pa.RecordBatch:
            rows = [(name, q, int(queries.ids[q]), -v, s) for q, heap in heaps.items() for s, v in heap]
            heaps.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (
                    pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))],
                ["q_block", "q_row", "query_id", "vec_id", "score"])

        for row in rows_of(batches):
            if not row["answer"]:
                yield flush()
                name, queries = row["q_block"], Block.of_row(row)
                best = np.full((len(queries.ids), k), -np.inf, queries.kind)
            else:
                search_tile(queries, Block.of_row(row), best, heaps)
        yield flush()
    return search


def dealt(queries: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """Each block of queries ahead of its blocks of candidates, in ``parts`` parts of those."""
    asked = queries.select("*", F.lit(None).cast("string").alias("block"), F.lit(False).alias("answer"),
                           F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    given = candidates.select("*", F.lit(True).alias("answer"),
                              F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"))
    return asked.unionByName(given).repartition("q_block", "part").sortWithinPartitions(
        "q_block", "part", "answer")


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` rows of largest cosine for each query row."""
    stages = Stages(spark, "block-search")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).where(
        usable("vector") & F.col("vec_id").isNotNull())
    asking = rows.where(is_query).dropDuplicates(["vec_id", "vector"]).repartition("vec_id")
    queries = stages.write("queries", asking.mapInArrow(block_packer(QUERY_BLOCK), BLOCK))
    queries = queries.withColumnRenamed("block", "q_block")
    candidates = rows.repartition("vec_id").mapInArrow(block_packer(CANDIDATE_BLOCK), BLOCK)
    candidates = stages.write("candidates", candidates)
    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = min(max(candidates.count(), 1), math.ceil(tasks / max(queries.count(), 1)))
    # every block of candidates meets each block of queries of its length
    names = sized_lookup(queries.select("size", "q_block"))
    rounded = ("q_block", "ids", *ROUNDED)
    tiles = dealt(queries.select(*rounded), candidates.join(names, "size").select(*rounded, "block"), parts)
    wanted = stages.write("wanted", tiles.mapInArrow(
        tile_filter(k), "q_block string, block string, wanted binary"))
    asks = wanted.groupBy("block").agg(F.collect_list(F.struct("q_block", "wanted")).alias("asks"))
    picked = candidates.select("block", "ids", "vectors").join(asks, "block").mapInArrow(
        wanted_picker, "q_block string, block string, ids binary, vectors binary")
    found = dealt(queries.select("q_block", "ids", "vectors"), picked, parts).mapInArrow(tile_searcher(k), FOUND)
    best = W.partitionBy("q_block", "q_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
