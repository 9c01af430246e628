"""Token-id files: flat unsigned integers, 64-bit document offsets, prefix sums of partition totals.

A shard is one range partition of the documents in ascending id order and has three files:
``.ids`` (little-endian unsigned integers, 16 or 32 bits by the vocabulary's size), ``.off`` (n + 1
64-bit offsets of documents into it) and ``.doc`` (n 64-bit ids). The manifest table names the shards
that finished tasks wrote and the base of each: the ids in all shards before it. A reader maps the
files into memory and adds the base.

Cases: a null text is an empty document, which still has its end id. Rows with equal or null ids
are documents of their own (nulls first, ``NULL_ID`` in the file). An empty table has no shard.
Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.byte_pieces import WordEncoder
from moundworks.llm.common import Stages, by_size

NULL_ID = -(1 << 63)
MANIFEST = "part int, stem string, width int, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(path: str):
    from pyarrow.fs import FileSystem
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        FileSystem.from_uri(f"file://{path}"))


def shard_writer(folder: str, tokenizer_path: str, end_id: int, added_tokens: bool):
    """Writes the documents of one partition, in their order, as one shard; returns its manifest row."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer_path, added_tokens)
        end = np.array([end_id], encoder.code).tobytes()
        width, part = len(end), TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        fs, path = _open(stem)
        if fs.type_name == "local":
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        docs, offsets, total, out = [], [np.zeros(1, "<i8")], 0, None
        try:
            for batch in by_size(batches):
                out = out or fs.open_output_stream(f"{path}.ids")
                ids = [encoder.encode(t or "") + end for t in batch.column("text").to_pylist()]
                out.write(b"".join(ids))
                ends = total + np.cumsum(np.array([len(x) // width for x in ids], "<i8"))
                total = int(ends[-1]) if len(ids) else total
                offsets.append(ends)
                docs.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        finally:
            if out is not None:
                out.close()
        if not docs:
            return
        for suffix, values in (("off", offsets), ("doc", docs)):
            with fs.open_output_stream(f"{path}.{suffix}") as f:
                f.write(np.concatenate(values).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "stem": [stem], "width": pa.array([width], pa.int32()),
            "n_docs": pa.array([sum(map(len, docs))], pa.int64()),
            "n_tokens": pa.array([total], pa.int64())})
    return write


def _map(fs, path: str, kind: str, count: int) -> np.ndarray:
    """A file's integers, mapped into memory where the file system can."""
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    with source as f:
        return np.frombuffer(f.read_buffer(count * np.dtype(kind).itemsize), kind)


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the shards that the manifest rows name."""
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = _open(row["stem"])
            ids = _map(fs, f"{path}.ids", f"<u{row['width']}", row["n_tokens"])
            off = _map(fs, f"{path}.off", "<i8", row["n_docs"] + 1)
            docs = _map(fs, f"{path}.doc", "<i8", row["n_docs"])
            for a in range(0, len(docs), 10_000):
                b = min(a + 10_000, len(docs))
                crc = [zlib.crc32(ids[off[i]:off[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs[a:b], mask=docs[a:b] == NULL_ID),
                    "start": pa.array(row["base"] + off[a:b]),
                    "n_tokens": pa.array(np.diff(off[a:b + 1])),
                    "ids_crc32": pa.array(crc, pa.int64())})


def write_token_files(docs: DataFrame, tokenizer_path: str, stages: Stages, end_id: int = 0,
                      added_tokens: bool = False) -> DataFrame:
    """Write all documents as shards; returns the manifest, one row per shard with its base.

    The texts move once, range partitioned by id, and are encoded once. The prefix sums run over one
    row per shard.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    write = shard_writer(stages.folder("tokens"), tokenizer_path, end_id, added_tokens)
    written = stages.write("written", ordered.mapInArrow(write, MANIFEST))
    base, bases = 0, []
    for part, n in written.select("part", "n_tokens").orderBy("part").collect():
        bases.append((part, base))
        base += n
    bases = docs.sparkSession.createDataFrame(bases, "part int, base long")
    return stages.write("manifest", written.join(F.broadcast(bases), "part"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: id, offset of its first id, number and checksum of ids."""
    return manifest.repartition("part").mapInArrow(read_shards, DOCUMENTS)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str,
                added_tokens: bool = False) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, Stages(spark, "token-files"),
                                              added_tokens=added_tokens))
