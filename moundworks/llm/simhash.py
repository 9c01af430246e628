"""Near copies by SimHash, linked by multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most
three bits differ in at most one bit of some segment, so each looks up, per segment, the small
Hamming ball around its own value in the table of all values; matches are verified over all 64
bits inside the join. Of two values one bit apart only the one with that bit set asks, and a pair
whose upper segments are near is not found again by the lower ones: every link comes out once.
Documents with one fingerprint are one entry of the table, however many they are.

Cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows share fingerprint and component; rows with a null id
keep their fingerprint and take the smallest non-null id as component; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import Stages, by_size, worker_cache
from moundworks.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
BLOCK_WORDS = 50_000


def _shingles(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Shingles of a text in blocks; white space is ASCII white space."""
    carried: list[bytes] = []
    first = True
    while text or first:
        words = text.split(None, BLOCK_WORDS)
        text = words.pop() if len(words) > BLOCK_WORDS else b""
        words = carried + words
        if first and len(words) < size:
            if words:
                yield [b" ".join(words)]
            return
        first, carried = False, words[len(words) - size + 1:]
        joined = b" ".join(words)
        ends, at = [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        yield [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[size - 1:])]


def fingerprinter(size: int, seed: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest
        worker_cache("simhash")
        for batch in by_size(batches):
            found = []
            for text in batch.column("text").to_pylist():
                ones, n = np.zeros(64, np.int64), 0
                for block in _shingles((text or "").encode().lower(), size):
                    hashes = np.array([xxh64_intdigest(s, seed) for s in block], ">u8")
                    ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(
                        0, dtype=np.uint32)
                    n += len(block)
                found.append(np.packbits(2 * ones > n).tobytes() if n else bytes(8))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array(np.frombuffer(b"".join(found), ">i8").astype(np.int64))],
                ["doc_id", "fingerprint"])
    return fingerprints


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint as a signed 64-bit integer) of every row."""
    return docs.select("doc_id", "text").mapInArrow(
        fingerprinter(size, seed), "doc_id long, fingerprint long")


def _segments(table: DataFrame) -> DataFrame:
    upper = F.shiftrightunsigned("fingerprint", 32)
    lower = F.col("fingerprint").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return table.select("*", F.posexplode(F.array(upper, lower)).alias("segment", "value"))


def links(table: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v): representatives of fingerprints at most ``distance`` <= 3 bits apart, each pair once.

    ``table`` has distinct ``fingerprint`` values and the ``rep`` of each.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments and balls of radius one find at most three differing bits")
    entries = _segments(table)
    cleared = F.expr("filter(transform(sequence(-1, 31), b -> if(b < 0, value, "
                     "if(shiftright(value, b) & 1 = 1, value ^ shiftleft(1L, b), null))), x -> x is not null)")
    asks = entries.select("segment", F.col("rep").alias("u"), F.col("fingerprint").alias("f"),
                          F.col("value").alias("own"), F.explode(cleared).alias("value"))
    entries = entries.select("segment", "value", "fingerprint", F.col("rep").alias("v"))
    differ = F.col("f").bitwiseXOR(F.col("fingerprint"))
    near = F.bit_count(differ) <= distance
    once = (F.col("a.value") != F.col("own")) | (F.col("f") < F.col("fingerprint"))
    new = (F.col("a.segment") == 0) | (F.bit_count(F.shiftrightunsigned(differ, 32)) > 1)
    same = (F.col("a.segment") == F.col("b.segment")) & (F.col("a.value") == F.col("b.value"))
    found = asks.alias("a").join(entries.alias("b"), same & near & once & new)
    return found.select("u", "v")


def near_copies(spark: SparkSession, docs: DataFrame, distance: int = MAX_DISTANCE,
                size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id); the component is the smallest id that links reach."""
    stages = Stages(spark, "simhash")
    rows = stages.write("fingerprints", fingerprints(docs, size))
    table = stages.write("table", rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = components(links(table.where("rep is not null"), distance), stages)
    groups = table.join(found, table["rep"] == found["node"], "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")
