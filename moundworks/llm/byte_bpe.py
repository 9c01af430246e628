"""Byte-level BPE by a rank file, with long texts encoded as overlapping chunks.

A text of at most ``CHUNK`` characters is one chunk. A longer one is cut every ``CHUNK`` characters
into chunks that overlap by ``OVERLAP``; they are rows of their own, pre-tokenised in parallel from
their own first character. Where two neighbours first begin a piece at the same place of their
overlap they have resynchronised: from there on both cut alike, so the text is stitched at that
place. Pieces between stitches are encoded in parallel and their ids joined in order. Where two
chunks never agree (one run without white space longer than the overlap), the two stay in one piece,
and the next stitch ends it. Decoding concatenates the raw bytes of the ids.

A stitch is kept only where white space follows a visible character and is no line break behind a
sign. Patterns whose pieces hold white space inside only as line breaks behind signs (as the public
ones do) always begin a piece there, wherever they began to read.

Cases: a null text is empty and has no ids; repeated rows and null ids are documents of their own;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks.llm.common import Stages, by_size, worker_cache

CHUNK, OVERLAP = 32_768, 512
ENCODED = "doc_id long, ids binary"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding_of(path: str, pattern: str):
    """The worker's encoder for a rank file."""
    cache = worker_cache("byte_bpe")
    if path not in cache:
        import tiktoken
        cache[path] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return cache[path]


def decoder_of(path: str) -> Callable[[list[int]], bytes]:
    cache = worker_cache("byte_bpe")
    key = f"{path} bytes"
    if key not in cache:
        cache[key] = {rank: token for token, rank in ranks_of(path).items()}
    lookup = cache[key].__getitem__
    return lambda ids: b"".join(map(lookup, ids))


def text_encoder(path: str, pattern: str):
    """Replaces ``text`` by ``ids``: little-endian unsigned 32-bit integers."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path, pattern)
        for batch in by_size(batches):
            ids = [np.array(encoding.encode_ordinary(t.as_py() or ""), "<u4").tobytes()
                   for t in batch.column("text")]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(ids, pa.binary())], [*names, "ids"])
    return encode


def chunk_cutter(chunk: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in by_size(batches):
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                uid += 1
                parts = [text[a:a + chunk + overlap] for a in range(0, len(text), chunk)]
                for a in range(0, len(parts), 256):
                    some = parts[a:a + 256]
                    yield pa.RecordBatch.from_pydict({
                        "uid": pa.array([uid] * len(some), pa.int64()),
                        "doc_id": pa.array([doc_id] * len(some), pa.int64()),
                        "k": pa.array(range(a, a + len(some)), pa.int32()),
                        "last": pa.array([a + i == len(parts) - 1 for i in range(len(some))]),
                        "text": pa.array(some, pa.string())})
    return cut


CHUNKS = "uid long, doc_id long, k int, last boolean, text string"


def boundary_finder(pattern: str, chunk: int, overlap: int):
    """Adds where pieces begin in the chunk's first ``overlap`` characters and in its neighbour's.

    Places are relative to the chunk whose head it is. Kept are those whose piece begins with white
    space after a visible character: what stands before cannot reach beyond them.
    """
    def seam(text: str, s: int) -> bool:
        before, at = text[s - 1:s], text[s]
        breaks = at in "\r\n" or "\x1c" <= at <= "\x1f"
        return at.isspace() and s > 0 and not before.isspace() and (before.isalnum() or not breaks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        pieces = regex.compile(pattern)
        for batch in by_size(batches):
            heads, tails = [], []
            for text in batch.column("text").to_pylist():
                starts = [m.start() for m in pieces.finditer(text) if m.end() < len(text)]
                seams = [s for s in starts if (s < overlap or s >= chunk) and seam(text, s)]
                heads.append([s for s in seams if s < overlap])
                tails.append([s - chunk for s in seams if s >= chunk])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, ints), pa.array(tails, ints)],
                [*batch.schema.names, "head", "tail"])
    return find


def stitched(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces of long texts: (uid, doc_id, piece, text), cut where neighbours resynchronise."""
    found = chunks.mapInArrow(boundary_finder(pattern, chunk, overlap),
                              f"{CHUNKS}, head array<int>, tail array<int>")
    row = W.partitionBy("uid").orderBy("k")
    common = F.array_intersect("head", F.lag("tail").over(row))
    seams = found.withColumn("cut", F.when(F.col("k") > 0, F.try_element_at(common, F.lit(1))))
    seams = seams.withColumn("own", (F.col("k") == 0) | F.col("cut").isNotNull())
    after = F.when(F.lead("own").over(row), F.lead("cut").over(row)).otherwise(0)
    begin = F.when(F.col("own"), F.coalesce("cut", F.lit(0))).otherwise(0)
    end = F.when(F.col("last"), F.length("text")).otherwise(chunk + after)
    parts = seams.select(
        "uid", "doc_id", "k", F.max(F.when(F.col("own"), F.col("k"))).over(row).alias("piece"),
        F.substring("text", begin + 1, end - begin).alias("text"))
    whole = F.array_sort(F.collect_list(F.struct("k", "text")))
    return parts.groupBy("uid", "doc_id", "piece").agg(
        F.array_join(F.transform(whole, lambda x: x["text"]), "").alias("text"))


def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b"".join(p["ids"] for p in parts) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())],
                                         ["doc_id", "ids"])


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every text; ``ids`` are little-endian unsigned 32-bit integers."""
    docs = docs.select("doc_id", "text")
    encoder = text_encoder(path, pattern)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    stages = Stages(spark, "byte-bpe")
    chunks = stages.write("chunks", docs.where(long).mapInArrow(chunk_cutter(chunk, overlap), CHUNKS))
    pieces = stitched(chunks.repartition("uid", "k"), pattern, chunk, overlap)
    pieces = pieces.mapInArrow(encoder, "uid long, doc_id long, piece int, ids binary")
    joined = pieces.groupBy("uid", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return docs.where(~long).mapInArrow(encoder, ENCODED).unionByName(
        joined.select("doc_id", "parts").mapInArrow(join_ids, ENCODED))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``: the raw bytes of the ids, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = decoder_of(path)
        for batch in batches:
            texts = [to_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])
    return encoded.mapInArrow(run, f"{ENCODED}, decoded binary")


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """Decodes one document at a time and returns the number of ids and checksums of the ids in
    decimals and of the decoded bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = decoder_of(path)
        for batch in batches:
            rows = []
            for raw in batch.column("ids"):
                ids = np.frombuffer(raw.as_py(), "<u4").tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(to_bytes(ids)).hexdigest()))
            n, of_ids, of_bytes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()),
                "decoded_sha256": pa.array(of_bytes, pa.string())})
    return encoded.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
