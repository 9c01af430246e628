"""Token counts: batches of texts, balanced by bytes, are encoded in Arrow functions that return lengths.

A worker takes about ``TEXT_BYTES`` of text at a time, however many rows that is. A text of over
``LONG_BYTES`` is split at safe boundaries (``piece_units``) into parts that are rows of their own,
dealt over the cluster and summed up again, so no task is longer than its bytes. For a ``.json`` file
of the tokenizers library a text is encoded as a whole, in the same batches.

Cases: a null or empty text has no bytes and no tokens; repeated rows and null ids are documents of
their own; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import Stages, by_size, worker_cache
from moundworks.llm.piece_units import PieceUnits

LONG_BYTES, PART_CHARS = 256 << 10, 64 << 10
COUNTS = "doc_id long, n_bytes long, n_tokens long"


class WholeTexts:
    """Lengths by a file of the tokenizers library, as it encodes by default, without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def parts(self, text: str, size: int) -> Iterator[str]:
        if text:
            yield text

    def of(self, parts: list[str]) -> list[list[int]]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [[len(e.ids)] for e in encoded]


def counter_of(path: str):
    """The worker's counter for a vocabulary file."""
    if path.endswith(".model"):
        return PieceUnits.of_worker("token_counts", path, len)
    cache = worker_cache("token_counts")
    if path not in cache:
        cache[path] = WholeTexts(path)
    return cache[path]


def text_counter(path: str):
    """Replaces ``text`` by ``n_tokens``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in by_size(batches):
            texts = batch.column("text").to_pylist()
            parts = [(i, p) for i, t in enumerate(texts) if t for p in counter.parts(t, PART_CHARS)]
            n = [0] * len(texts)
            for (i, _), lengths in zip(parts, counter.of([p for _, p in parts])):
                n[i] += sum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    return count


PARTS = "uid long, k int, doc_id long, n_bytes long, text string"


def part_cutter(path: str):
    """Parts of long texts; rows of one text share a ``uid``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, uid = counter_of(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, n_bytes, text = (batch.column(c)[i].as_py() for c in ("doc_id", "n_bytes", "text"))
                uid += 1
                for k, part in enumerate(counter.parts(text, PART_CHARS)):
                    yield pa.RecordBatch.from_pydict({
                        "uid": pa.array([uid], pa.int64()), "k": pa.array([k], pa.int32()),
                        "doc_id": pa.array([doc_id], pa.int64()), "n_bytes": pa.array([n_bytes], pa.int64()),
                        "text": pa.array([part], pa.string())})
    return cut


def part_counter(path: str):
    """Tokens of parts, which are strings of the text as the library sees it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in by_size(batches):
            n = list(map(sum, counter.of(batch.column("text").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "doc_id", "n_bytes")), pa.array(n, pa.int64())],
                ["uid", "doc_id", "n_bytes", "n_tokens"])
    return count


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text by a ``.model`` or ``.json`` file."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = docs.select("doc_id", "text", size.alias("n_bytes"))
    long = F.col("n_bytes") > long_bytes
    short = docs.where(~long).mapInArrow(text_counter(path), COUNTS)
    parts = Stages(spark, "token-counts").write("parts", docs.where(long).mapInArrow(part_cutter(path), PARTS))
    counted = parts.repartition("uid", "k").mapInArrow(
        part_counter(path), "uid long, doc_id long, n_bytes long, n_tokens long")
    summed = counted.groupBy("uid", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(summed.drop("uid"))
