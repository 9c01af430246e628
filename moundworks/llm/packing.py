"""Concatenate and cut: documents as one stream of ids, cut every ``window`` tokens.

Pass one encodes each partition once and stores, per document, its ids and its place in the
partition's stream. The partition totals (one row per task) are summed up on the driver to the
offset of each partition in the whole stream. Pass two adds that offset and cuts the documents at
the window borders; only the last sequence needs padding. No text or id is shuffled.

Cases: a null text is an empty document with its end id alone; repeated rows and null ids are
documents of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.byte_pieces import WordEncoder
from moundworks.llm.common import Stages, by_size

WINDOW = 1024
ENCODED = "part int, at long, doc_id long, doc_tokens long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


def stream_encoder(tokenizer_path: str, end_id: int, added_tokens: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer_path, added_tokens)
        end = np.array([end_id], encoder.code).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in by_size(batches):
            ids = [encoder.encode(t or "") + end for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) // len(end) for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(ids), part, np.int32)), "at": pa.array(starts),
                "doc_id": batch.column("doc_id"), "doc_tokens": pa.array(sizes),
                "ids": pa.array(ids, pa.binary())})
    return encode


def cutter(window: int, keep_ids: bool):
    """Pieces of documents that know their place in the whole stream (``at``)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, at, n, raw in zip(*(batch.column(c).to_pylist()
                                            for c in ("doc_id", "at", "doc_tokens", "ids"))):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[start:start + length].tobytes()
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset,
                                 piece if keep_ids else None))
                    start += length
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)
    return cut


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW,
         end_id: int = 0, keep_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row per piece; with ``keep_ids`` its ids as little-endian 32-bit integers."""
    stages = Stages(spark, "packing")
    encoded = stages.write("encoded", docs.select("doc_id", "text").mapInArrow(
        stream_encoder(tokenizer_path, end_id, added_tokens), ENCODED))
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens")).orderBy("part").collect()
    base, bases = 0, []
    for part, n in totals:  # one row per task of pass one
        bases.append((part, base))
        base += n
    bases = spark.createDataFrame(bases, "part int, base long")
    placed = encoded.join(F.broadcast(bases), "part").withColumn("at", F.col("at") + F.col("base"))
    pieces = placed.select("doc_id", "at", "doc_tokens", "ids").mapInArrow(
        cutter(window, keep_ids), PIECES)
    return pieces if keep_ids else pieces.drop("ids")
