"""Repeated byte strings by an enhanced suffix array and its common-prefix interval tree.

Every byte covered by a string of ``MIN_BYTES`` bytes that also starts in a document with a smaller
id is removed. Steps:

1. Each start of a ``MIN_BYTES`` string gets a key, the smallest hash of the ``GRAM``-byte grams
   inside it, so equal strings have equal keys. Consecutive starts with one key are a run. Runs are
   sent, packed, to buckets of keys; those whose key occurs in one text only go. Keys that a
   sample shows in a large share of the documents are dealt out by text instead: they stay anyway.
2. The bytes of the runs left are cut from the texts. Equal cuts are one, with the smallest and
   largest document, however often they occur.
3. Each task sorts the suffixes of the cuts of its keys whose first ``MIN_BYTES`` bytes occur
   again (a suffix array with its common prefixes), scans the tree of common-prefix intervals with a stack, and puts out the maximal repeats: groups
   of at least ``MIN_BYTES`` whose left neighbours differ, with all their occurrences. A key with
   more than ``ARRAY_CUTS`` cuts fits no array: its cuts fall into their strings, and equal strings meet in
   an aggregate, whose size does not depend on how often one occurs.
4. Every start learns the smallest document of the repeats that hold it; where that is smaller than
   its own document, the string is removed. Copies of a whole text are settled by their checksum.

Cases: a null text is empty; texts shorter than ``MIN_BYTES`` lose nothing; rows with one id do not
remove each other's bytes; rows with a null id come after all others; repeated rows get equal
results; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import Stages, by_size, worker_cache

MIN_BYTES, GRAM = 50, 24
WINDOW = MIN_BYTES - GRAM + 1
#: Starts of one run at most; longer ones (periodic text) are several runs of one key.
MAX_RUN = 64
WIDTH = MIN_BYTES + MAX_RUN - 1
#: Bytes hashed at a time, runs in a bucket, cuts in a suffix array.
GROUP_BYTES, BUCKET_RUNS, ARRAY_CUTS = 1 << 18, 1_000_000, 25_000
#: Documents in the sample for frequent keys, and the share of them that makes a key frequent.
SAMPLE_DOCS, FREQUENT_SHARE = 2_000, 0.02
#: Intervals, and members or places of them, that a task spreads at a time.
GROUPS_AT_ONCE, PLACES_AT_ONCE = 2_000, 1 << 18
#: Texts whose copies a packing task knows.
MET_TEXTS = 1 << 17
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed polynomial hash of the ``GRAM`` bytes at each place."""
    one = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _power(1) + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    sixteen = eight[:-8] * _power(8) + eight[8:]
    h = sixteen[:-8] * _power(8) + eight[16:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray) -> np.ndarray:
    for step in (1, 2, 4, 8):
        h = np.minimum(h[:-step], h[step:])
    return np.minimum(h[:len(h) - (WINDOW - 16)], h[WINDOW - 16:])


def _parts(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, place, bytes); long texts come in parts that overlap by a string less one."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - MIN_BYTES + 1, 0), GROUP_BYTES):
            part = text[at:at + GROUP_BYTES + MIN_BYTES - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first start, number of starts, key) of all runs, group by group."""
    for group in _parts(texts):
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        key = window_minima(gram_hashes(np.frombuffer(b"".join(p for _, _, p in group), np.uint8)))
        part = np.repeat(np.arange(len(group)), sizes)[:len(key)]
        start = np.arange(len(key)) - (ends - sizes)[part]
        inside = start <= (sizes - MIN_BYTES)[part]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        first &= inside
        heads = np.flatnonzero(first)
        # a run ends at the next head or where its part has no more starts
        stop = np.minimum(np.append(heads[1:], len(key)), ((ends - sizes) + sizes - MIN_BYTES + 1)[part[heads]])
        pieces = -(-(stop - heads) // MAX_RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(heads, pieces) + nth * MAX_RUN
        count = np.minimum(np.repeat(stop, pieces) - begin, MAX_RUN)
        owner = part[begin]
        yield (np.array([i for i, _, _ in group])[owner], start[begin] + np.array([a for _, a, _ in group])[owner],
               count, key[begin])


def _bytes(column) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def frequent_keys(docs: DataFrame) -> np.ndarray:
    """Keys in many documents of a bounded sample: at most (runs of a document) / share of them."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            texts, hashes = _bytes(batch.column("text")), np.array(batch.column("same").to_pylist(), np.int64)
            for text, _, _, key in runs_of(texts):
                pair = np.unique(np.stack([hashes[text], key.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_pydict({"same": pa.array(pair[0]), "key": pa.array(pair[1])})
    chosen = docs.select("same").distinct().orderBy(F.xxhash64("same")).limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(chosen), "same").dropDuplicates(["same"])
    n = max(2, int(SAMPLE_DOCS * FREQUENT_SHARE))
    found = sample.select("same", "text").mapInArrow(keys, "same long, key long").groupBy("key").agg(
        F.count_distinct("same").alias("n")).where(F.col("n") >= n)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64))


PACKED = "bucket long, frequent boolean, same binary, key binary, start binary, count binary"
RUNS = "same long, start int, n int, key long"


def run_packer(buckets: int, frequent):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("repeats")
        common = frequent.value
        met: set[bytes] = set()
        for batch in by_size(batches):
            # copies count once, so a task sends the runs of a text once
            if len(met) > MET_TEXTS:
                met.clear()
            texts, new = _bytes(batch.column("text")), []
            for i, text in enumerate(texts):
                n = len(met)
                met.add(hashlib.sha256(text).digest())
                if len(met) > n:
                    new.append(i)
            hashes = np.array(batch.column("same").to_pylist(), np.int64)[new]
            found = list(runs_of([texts[i] for i in new]))
            if not found:
                continue
            text, start, count, key = (np.concatenate(c) for c in zip(*found))
            same, key = hashes[text], key.view(np.int64)
            often = np.zeros(len(key), bool)
            if len(common):
                often = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key
            bucket = (np.where(often, same, key).view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            place = 2 * bucket + often
            order = np.argsort(place, kind="stable")
            place = place[order]
            cuts = np.flatnonzero(np.diff(place)) + 1
            edges = [0, *cuts.tolist(), len(place)]
            columns = (same[order].astype("<i8"), key[order].astype("<i8"), start[order].astype("<i4"),
                       count[order].astype("<u1"))
            blobs = [[c[a:b].tobytes() for a, b in zip(edges, edges[1:])] for c in columns]
            which = place[edges[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(which), pa.array(which % 2 == 1), *(pa.array(b, pa.binary()) for b in blobs)],
                ["bucket", "frequent", "same", "key", "start", "count"])
    return pack


def shared_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the runs whose key occurs in two texts; copies of a text count once."""
    same, key, start, count = (np.frombuffer(b"".join(rows[c]), kind) for c, kind in (
        ("same", "<i8"), ("key", "<i8"), ("start", "<i4"), ("count", "<u1")))
    order = np.lexsort((start, same, key))
    same, key, start, count = same[order], key[order], start[order], count[order]
    new_key = np.append(True, key[1:] != key[:-1])
    new_text = new_key | np.append(True, same[1:] != same[:-1])
    keep = new_text | np.append(True, start[1:] != start[:-1])
    if not rows["frequent"].iloc[0]:
        group = np.cumsum(new_key) - 1
        keep &= np.bincount(group, new_text)[group] > 1
    return pd.DataFrame({"same": same[keep], "start": start[keep], "n": count[keep].astype(np.int32),
                         "key": key[keep]})


class SuffixArray:
    """Suffixes of short strings, in order, with the length each shares with the one before."""

    def __init__(self, cuts: list[bytes]):
        sizes = np.array([len(c) for c in cuts])
        per = sizes - MIN_BYTES + 1
        self.cut = np.repeat(np.arange(len(cuts)), per)
        self.at = np.arange(len(self.cut)) - np.repeat(np.cumsum(per) - per, per)
        text = np.frombuffer(b"".join(cuts) + bytes(WIDTH), np.uint8)
        place = (np.cumsum(sizes) - sizes)[self.cut] + self.at
        prefix = string_hashes(text, place)
        # a suffix whose first string occurs once shares no interval with another
        order = np.argsort(prefix)
        same = np.append(False, prefix[order][1:] == prefix[order][:-1])
        met = np.sort(order[same | np.append(same[1:], False)])
        self.cut, self.at, place = self.cut[met], self.at[met], place[met]
        length = sizes[self.cut] - self.at
        left = np.where(self.at > 0, text[place - 1].astype(np.int64), -1)
        table = np.lib.stride_tricks.sliding_window_view(text, WIDTH)[place]
        table[np.arange(WIDTH)[None, :] >= length[:, None]] = 0
        order = np.argsort(table.view(f"S{WIDTH}").ravel(), kind="stable")
        self.cut, self.at, self.left, length = self.cut[order], self.at[order], left[order], length[order]
        self.common = np.zeros(len(order), np.int64)
        for a in range(1, len(order), 32_768):
            b = min(a + 32_768, len(order))
            some = table[order[a - 1:b]]
            differ = some[1:] != some[:-1]
            first = np.where(differ.any(1), differ.argmax(1), WIDTH)
            self.common[a:b] = np.minimum(first, np.minimum(length[a:b], length[a - 1:b - 1]))

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the intervals of at least ``MIN_BYTES`` whose left bytes differ.

        A stack holds the open intervals, each inside the one below. Left is the byte before all of
        an interval's suffixes, or -1 if they differ; the first suffix of a cut differs from all.
        """
        common, left = self.common, self.left.tolist()
        inside = np.flatnonzero(common >= MIN_BYTES)
        if not len(inside):
            return
        breaks = np.flatnonzero(np.diff(inside) > 1) + 1
        for block in np.split(inside, breaks):
            low, high = int(block[0]) - 1, int(block[-1])
            lcp = common[low + 1:high + 1].tolist()
            stack: list[list[int]] = []  # length, first, left
            for k in range(low + 1, high + 2):
                now = lcp[k - low - 1] if k <= high else 0
                first, before = k - 1, left[k - 1]
                while stack and stack[-1][0] > now:
                    length, first, seen = stack.pop()
                    before = seen if seen == before else -1
                    if before == -1:
                        yield length, first, k - 1
                if now:
                    if stack and stack[-1][0] == now:
                        if stack[-1][2] != before:
                            stack[-1][2] = -1
                    else:
                        stack.append([now, first, before])


def smallest_documents(cuts: list[bytes], lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start of every cut, the smallest document of the repeats that hold its string.

    Returns the offsets of the cuts' starts and the documents.
    """
    per = np.array([len(c) for c in cuts]) - MIN_BYTES + 1
    offset = np.cumsum(per) - per
    smallest = np.repeat(lowest, per)  # equal cuts are a repeat of their own
    array = SuffixArray(cuts)
    groups = np.array(list(array.maximal_repeats()), np.int64).reshape(-1, 3)
    place, documents = offset[array.cut] + array.at, lowest[array.cut]
    for some in _batches(groups[:, 2] - groups[:, 1] + 1, GROUPS_AT_ONCE):
        length, first, last = groups[some].T
        low = np.minimum.reduceat(np.append(documents, LAST), np.stack([first, last + 1], 1).ravel())[::2]
        group, member = _expanded(last - first + 1)
        member += first[group]
        above = documents[member] > low[group]
        group, member = group[above], member[above]
        for part in _batches(length[group] - MIN_BYTES + 1, PLACES_AT_ONCE):
            which, shift = _expanded(length[group[part]] - MIN_BYTES + 1)
            np.minimum.at(smallest, place[member[part]][which] + shift, low[group[part]][which])
    return offset, smallest


def _batches(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbours of about ``PLACES_AT_ONCE`` in all, at most ``most``, or one larger one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = int(np.searchsorted(ends, before + PLACES_AT_ONCE, "right"))
        b = min(max(b, a + 1), a + most)
        yield slice(a, b)
        a = b


def _expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count n, its index n times and 0 to n - 1."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


REMOVALS = "key long, cut long, removals array<struct<first:int,last:int,low:long>>"


def array_scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of each cut whose string also starts in a document below its largest."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    cuts = table.column("bytes").to_pylist()
    lowest, highest = (table.column(c).to_numpy() for c in ("lowest", "highest"))
    offset, smallest = smallest_documents(cuts, lowest)
    head = np.zeros(len(smallest), bool)
    head[offset] = True
    begins = np.flatnonzero(head | np.append(True, smallest[1:] != smallest[:-1]))
    owner = np.searchsorted(offset, begins, "right") - 1
    ends = np.append(begins[1:], len(smallest))
    removed = smallest[begins] < highest[owner]
    begins, owner, ends = begins[removed], owner[removed], ends[removed]
    with_any, counts = np.unique(owner, return_counts=True)
    spans = pa.StructArray.from_arrays(
        [pa.array((begins - offset[owner]).astype(np.int32)),
         pa.array((ends - 1 - offset[owner]).astype(np.int32)), pa.array(smallest[begins])],
        ["first", "last", "low"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)
    yield pa.RecordBatch.from_arrays(
        [table.column(c).combine_chunks().take(pa.array(with_any)) for c in ("key", "cut")] + [lists],
        ["key", "cut", "removals"])


def string_removals(cuts: DataFrame) -> DataFrame:
    """What ``array_scanner`` finds, for cuts of keys that fit no array, from each string by itself."""
    starts = F.sequence(F.lit(0), F.octet_length("bytes") - MIN_BYTES)
    strings = cuts.select("key", "cut", "lowest", "highest", "bytes", F.explode(starts).alias("at")).withColumn(
        "string", F.expr(f"substring(bytes, at + 1, {MIN_BYTES})")).drop("bytes")
    low = strings.groupBy("string").agg(F.min("lowest").alias("low"), F.max("highest").alias("high")).where(
        F.col("low") < F.col("high"))
    removed = strings.join(low, "string").where(F.col("low") < F.col("highest"))
    return removed.groupBy("key", "cut").agg(F.collect_list(F.struct(
        F.col("at").alias("first"), F.col("at").alias("last"), "low")).alias("removals"))


def string_hashes(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of the ``MIN_BYTES`` bytes at each place."""
    grams = gram_hashes(text)
    both = (grams[place] * np.uint64(3) + grams[place + GRAM]) * np.uint64(5) + grams[place + MIN_BYTES - GRAM]
    both ^= both >> np.uint64(32)
    return both * np.uint64(BASE)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(row, spans): all columns, and the removed strings in UTF-8 bytes, which may overlap."""
    stages = Stages(spark, "repeats", compression="zstd")
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(
        F.lit(0).alias("-"), *others).alias("others")).select(
        "doc_id", "text", "others", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("same"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    firsts = stages.write("firsts", rows.groupBy("same", F.sha2("text", 256).alias("sum")).agg(
        F.min("doc").alias("first")))
    frequent = spark.sparkContext.broadcast(frequent_keys(rows))
    buckets = 1 + 2 * size // ((WINDOW + 1) * BUCKET_RUNS)
    packed = rows.select("same", "text").mapInArrow(run_packer(buckets, frequent), PACKED)
    runs = stages.write("runs", packed.groupBy("bucket").applyInPandas(shared_runs, RUNS))

    # the bytes of the runs, from the first document of each text
    listed = runs.groupBy("same").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))
    sources = listed.join(firsts.select("same", F.col("first").alias("doc")), "same")
    cut = F.transform(F.array(F.col("text").cast("binary")), lambda text: F.transform(
        "runs", lambda r: F.struct(
            r["start"].alias("start"), r["key"].alias("key"),
            F.substring(text, r["start"] + 1, r["n"] + MIN_BYTES - 1).alias("bytes"))))[0]
    cuts = rows.select("same", "doc", "text").join(sources, ["same", "doc"]).select(
        "same", "doc", F.inline(cut)).withColumn("cut", F.xxhash64("bytes"))
    cuts = stages.write("cuts", cuts)
    stages.remove("runs")
    distinct = cuts.groupBy("key", "cut", "bytes").agg(
        F.min("doc").alias("lowest"), F.max("doc").alias("highest"))
    distinct = stages.write("distinct", distinct)
    large = stages.write("large", distinct.groupBy("key").agg(F.count("*").alias("n")).where(
        F.col("n") > ARRAY_CUTS).select("key"))
    tasks = 1 + distinct.count() // ARRAY_CUTS
    found = distinct.join(large, "key", "left_anti").repartition(int(tasks), "key").mapInArrow(
        array_scanner, REMOVALS)
    found = stages.write("found", found.unionByName(string_removals(distinct.join(large, "key"))))
    stages.remove("distinct", "large")

    # back to the documents
    removals = cuts.select("same", "doc", "start", "key", "cut").join(found, ["key", "cut"])
    spans = F.transform(F.filter("removals", lambda r: r["low"] < F.col("doc")), lambda r: F.struct(
        (F.col("start") + r["first"]).alias("a"), (F.col("start") + r["last"] + MIN_BYTES).alias("b")))
    per_text = removals.select("same", "doc", F.inline(spans)).groupBy("same", "doc").agg(
        F.collect_list(F.struct("a", "b")).alias("spans"))
    known = firsts.select("same", "sum", "first").join(
        per_text.withColumnRenamed("doc", "first"), ["same", "first"], "left")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.octet_length("text").alias("b")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    joined = rows.withColumn("sum", F.sha2("text", 256)).join(known, ["same", "sum"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.octet_length("text") >= MIN_BYTES)
    own = [F.col("others")[c].alias(c) if c not in ("doc_id", "text") else F.col(c) for c in docs.columns]
    return joined.select(F.struct(*own).alias("row"), F.when(copy, whole).when(
        F.col("doc") == F.col("first"), F.coalesce("spans", none)).otherwise(none).alias("spans"))


def without_repeats(found: DataFrame) -> DataFrame:
    """The rows with the characters that lie wholly in removed bytes taken out of ``text``."""
    schema = found.schema["row"].dataType
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            row = batch.column("row")
            for text, spans in zip(row.field("text"), batch.column("spans")):
                data, parts, at = text.as_py().encode(), [], 0
                for a, b in merged([(s["a"], s["b"]) for s in spans.as_py()]):
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    parts.append(data[at:a])
                    at = b
                texts.append(b"".join([*parts, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else row.field(c) for c in names], names)
    return found.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Sizes, removed bytes and runs, and the checksum of the bytes that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("row").field("text"), batch.column("spans")):
                data, kept, at = (text.as_py() or "").encode(), hashlib.sha256(), 0
                spans = merged([(s["a"], s["b"]) for s in spans.as_py()])
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").field("doc_id"),
                 *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return found.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
