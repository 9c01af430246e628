"""Alignment of two tokenizers' tokens and corpus-wide counts of the id pairs they link.

Byte offsets where tokens of both end cut a text into groups; all pairs of one group are linked. The
first pass encodes and aligns the documents and stores their ids in batches of about ``BATCH_BYTES`` of
text, with the distinct pairs of each batch and how many of its documents hold them, in ``BLOCKS`` blocks by the first id. The
distinct pairs of a block get a minimal perfect hash; batches add their numbers to dense vectors indexed
by it, and the vectors are summed in a tree. The table of a block keeps each slot's pair, against
which a lookup is verified, its count, and whether that is the highest of its first id, whose pairs are
all in this block. Batches look their pairs up there, and the second pass aligns the documents again,
from the stored ids, and takes the counts. A block has at most (first ids / ``BLOCKS``) times (second ids) pairs;
every step streams over sorted partitions, so no batch list, block list or corpus is held as one.

Cases: texts that are null or empty, or whose tokens of either kind do not join to a space and the
text, have no tokens and zeros; repeated rows and null ids are documents of their own; a text longer
than a batch is a batch by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.byte_pieces import PIECES, PLAIN, SPACE_RUNS, PieceEncoder, byte_letters
from moundworks.llm.common import Stages, by_size, worker_cache
from moundworks.llm.perfect_hash import PerfectHash, build
from moundworks.llm.piece_units import CACHED_CHARS, SPACE, PieceUnits

BATCH_BYTES, BLOCKS = 8 << 20, 256
#: Vectors or key lists that one task adds up before the next level of the tree.
FAN_IN = 512
#: Both tokenizers begin a token here.
SEAM = re.compile(rf"(?<=[^\s\x1c-\x1f\x85{SPACE}])(?=[ \n])")
PART_CHARS, ROUND_TOKENS, SMALL_GROUP = 1 << 18, 1 << 17, 256
#: Text a worker encodes at a time, and pairs it holds before it takes equal ones together.
CHUNK_BYTES, HELD_PAIRS = 1 << 19, 1 << 19
#: Words of a generation that are looked up, new ones encoded by one call, and pieces of other texts.
CACHED_WORDS, WORDS_AT_ONCE, CACHED_PIECES, SECOND = 80_000, 1_024, 10_000, 1 << 31


class ByteUnits(PieceEncoder):
    """Ids of pieces, of which few are held, as most texts are looked up by ``WordIds``."""

    most, longest, taken = CACHED_PIECES, CACHED_CHARS, PIECES.pattern


class WordIds(dict):
    """Ids of both tokenizers for a space and the characters up to the next one, by those characters, in
    two generations; the second tokenizer's have the bit ``SECOND``.

    In texts that ``reads`` accepts such a space begins a piece of the one and a unit of the other. So new
    words are encoded by one call for many of them, and cut where their bytes end.
    """

    def __init__(self, a: ByteUnits, b: PieceUnits, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.b, self.a_size, self.b_size = a, b, a_size, b_size
        self.splits = a.by_rank is not None and b.splits
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def reads(self, part: str) -> bool:
        return (self.splits and part[0] == " " and not any(run in part for run in SPACE_RUNS)
                and PLAIN.fullmatch(part) is not None)

    def _learn(self, words: list[str]) -> None:
        """Ids of words that end in a visible character."""
        text = " ".join(words)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        found, owners, edges = [], [], np.zeros(len(words) + 1, np.int64)
        for ids, size, mark in ((self.a.by_rank.encode_ordinary(f" {text}"), self.a_size, 0),
                                (self.b.processor.encode(text), self.b_size, SECOND)):
            ids = np.array(ids, np.uint32)
            token_end = np.cumsum(size[ids])
            last = np.searchsorted(token_end, ends)
            if not (token_end[last] == ends).all():
                raise RuntimeError("a token reaches across the space in front of a word")
            edges[1:] += last + 1
            owners.append(np.repeat(np.arange(len(words)), np.diff(last, prepend=-1)))
            found.append(ids | np.uint32(mark))
        raw = np.concatenate(found)[np.argsort(np.concatenate(owners), kind="stable")].tobytes()
        places = (4 * edges).tolist()
        self.update(zip(words, [raw[x:y] for x, y in zip(places, places[1:])]))

    def of(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of either kind of each part."""
        split = [p[1:].split(" ") for p in parts]
        new = set().union(*split).difference(self)
        again = [w for w in new if w in self.old]
        self.update(zip(again, map(self.old.__getitem__, again)))
        blank = [w for w in new if not w or w[-1].isspace()]  # only the last of a part
        for word in blank:
            self[word] = (np.frombuffer(self.a.plain(f" {word}"), self.a.code).astype(np.uint32).tobytes()
                          + (np.frombuffer(b"".join(self.b.of([f" {word}"])[0]), self.b.code)
                             | np.uint32(SECOND)).tobytes())
        new = list(new.difference(again, blank))
        for i in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[i:i + WORDS_AT_ONCE])
        found = []
        for words in split:
            ids = np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint32).astype(np.int64)
            second = ids >= SECOND
            found.append((ids[~second], ids[second] - SECOND))
        for word in new:
            if len(word) >= CACHED_CHARS:
                del self[word]
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        return found


class Tokenizers:
    """The worker's two encoders and the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteUnits(byte_path), PieceUnits(piece_path)
        self.a_bytes, self.b_bytes = self.a.token_bytes, self.b.token_bytes
        self.a_size, self.b_size = (np.array([len(t) for t in table], np.int64)
                                    for table in (self.a_bytes, self.b_bytes))
        self.words = WordIds(self.a, self.b, self.a_size, self.b_size)

    @classmethod
    def of_worker(cls, byte_path: str, piece_path: str) -> Tokenizers:
        cache, key = worker_cache("alignment"), f"{byte_path}|{piece_path}"
        if key not in cache:
            cache[key] = cls(byte_path, piece_path)
        return cache[key]

    @cached_property
    def written(self) -> list[str]:
        """Ids in decimal followed by what separates them, for the text form of groups."""
        return [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                for end in ends for i in range(n)]

    def _differs(self, part: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the bytes of either kind are not the part's."""
        if self.a.lossless and self.b.splits:  # both keep every byte but those of the space's own sign
            return SPACE in part
        raw = part.encode()
        return (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw)

    def encode(self, texts: list[str | None]) -> Encoded:
        """Ids of both tokenizers for each part of each text; no parts if one loses bytes."""
        parts = []
        for owner, text in enumerate(texts):
            at, text = 0, f" {text}" if text else ""
            while len(text) - at > PART_CHARS and self.b.splits:
                seam = SEAM.search(text, at + PART_CHARS)
                if seam is None:
                    break
                parts.append((owner, text[at:seam.start()]))
                at = seam.start()
            if text:
                parts.append((owner, text[at:]))
        read = [self.words.reads(p) for _, p in parts]
        by_word = iter(self.words.of([p for (_, p), r in zip(parts, read) if r]))
        by_unit = iter(self.b.of([p.replace(SPACE, " ") if self.b.splits else p[1:]
                                  for (_, p), r in zip(parts, read) if not r]))
        out, differing = [[] for _ in texts], set()
        for (owner, part), r in zip(parts, read):
            a, b = next(by_word) if r else (
                np.frombuffer(self.a.encode(part), self.a.code).astype(np.int64),
                np.frombuffer(b"".join(next(by_unit)), self.b.code).astype(np.int64))
            out[owner].append((a, b))
            if self._differs(part, a, b):
                differing.add(owner)
        return [[] if owner in differing else found for owner, found in enumerate(out)]


class Groups:
    """The groups of some parts of texts, one after the other; ``owner`` numbers the texts."""

    def __init__(self, tokenizers: Tokenizers, parts: list[tuple[int, np.ndarray, np.ndarray]]):
        self.tokenizers = tokenizers
        owner = np.array([o for o, _, _ in parts], np.int64)
        self.a = np.concatenate([a for _, a, _ in parts])
        self.b = np.concatenate([b for _, _, b in parts])
        a_end, b_end = np.cumsum(tokenizers.a_size[self.a]), np.cumsum(tokenizers.b_size[self.b])
        ends = np.zeros(int(a_end[-1]) + 1, bool)
        ends[a_end] = True
        cut = ends[b_end]  # parts have equal bytes of both, so each part ends at a cut
        common = b_end[cut]
        self.of_b = np.cumsum(cut) - cut
        self.of_a = np.searchsorted(common, a_end)
        self.n_a, self.n_b = np.bincount(self.of_a), np.bincount(self.of_b)
        self.first_a, self.first_b = np.cumsum(self.n_a) - self.n_a, np.cumsum(self.n_b) - self.n_b
        part_end = np.cumsum([int(tokenizers.a_size[a].sum()) for _, a, _ in parts])
        self.owner = owner[np.searchsorted(part_end, common)]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, pair, how many links) in blocks; a pair may come several times."""
        size = self.n_a * self.n_b
        token = np.flatnonzero(size[self.of_a] <= SMALL_GROUP)
        group = self.of_a[token]
        times = self.n_b[group]
        b = np.arange(times.sum()) + np.repeat(self.first_b[group] - np.cumsum(times) + times, times)
        pair = np.repeat(self.a[token] << 32, times) | self.b[b]
        yield np.repeat(self.owner[group], times), pair, np.ones(len(pair), np.int64)
        for g in np.flatnonzero(size > SMALL_GROUP):
            a, times_a = np.unique(self.a[self.first_a[g]:][:self.n_a[g]], return_counts=True)
            b, times_b = np.unique(self.b[self.first_b[g]:][:self.n_b[g]], return_counts=True)
            step = max(1, ROUND_TOKENS // len(b))
            for i in range(0, len(a), step):
                pair = (a[i:i + step, None] << 32 | b[None]).ravel()
                yield (np.full(len(pair), self.owner[g]), pair,
                       (times_a[i:i + step, None] * times_b[None]).ravel())

    def written(self) -> Iterator[tuple[int, str]]:
        """(owner, ``a1,a2|b1;`` for its groups in order), texts in order."""
        n = len(self.tokenizers.a_bytes), len(self.tokenizers.b_bytes)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.zeros(len(self.a), bool)
        last_b = np.zeros(len(self.b), bool)
        last_a[self.first_a + self.n_a - 1] = last_b[self.first_b + self.n_b - 1] = True
        out[np.arange(len(self.a)) + self.first_b[self.of_a]] = self.a + n[0] * last_a
        out[np.arange(len(self.b)) + (self.first_a + self.n_a)[self.of_b]] = 2 * n[0] + self.b + n[1] * last_b
        words = list(map(self.tokenizers.written.__getitem__, out.tolist()))
        starts = np.flatnonzero(np.diff(self.owner, prepend=-1))
        places = (self.first_a + self.first_b)[starts].tolist() + [len(words)]
        for owner, x, y in zip(self.owner[starts].tolist(), places, places[1:]):
            yield owner, "".join(words[x:y])


Encoded = list[list[tuple[np.ndarray, np.ndarray]]]


def rounds(tokenizers: Tokenizers, encoded: Encoded) -> Iterator[Groups]:
    """The groups of encoded texts in order; a text of several rounds shares none of them."""
    waiting, size = [], 0
    for owner, own in enumerate(encoded):
        parts = [(owner, a, b) for a, b in own]
        n = sum(len(a) + len(b) for _, a, b in parts)
        if waiting and size + n > ROUND_TOKENS:
            yield Groups(tokenizers, waiting)
            waiting, size = [], 0
        if n > ROUND_TOKENS:
            for part in parts:
                yield Groups(tokenizers, [part])
        else:
            waiting, size = waiting + parts, size + n
    if waiting:
        yield Groups(tokenizers, waiting)


def stored(encoded: Encoded) -> tuple[bytes, bytes]:
    """Encoded texts as (owner, ids of either kind) per part, and all ids, compressed."""
    parts = [(owner, a, b) for owner, own in enumerate(encoded) for a, b in own]
    sizes = np.array([(owner, len(a), len(b)) for owner, a, b in parts], "<i8")
    ids = np.concatenate([x for _, a, b in parts for x in (a, b)] or [np.empty(0, "<u4")])
    width = "<u2" if len(ids) == 0 or ids.max() < 1 << 16 else "<u4"
    return sizes.tobytes(), width.encode() + zstandard.ZstdCompressor(level=3).compress(ids.astype(width).tobytes())


def restored(n: int, sizes: bytes, ids: bytes) -> Encoded:
    out: Encoded = [[] for _ in range(n)]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids[3:]), ids[:3].decode()).astype(np.int64)
    at = 0
    for owner, a, b in np.frombuffer(sizes, "<i8").reshape(-1, 3).tolist():
        out[owner].append((raw[at:at + a], raw[at + a:at + a + b]))
        at += a + b
    return out


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.concatenate(pairs)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[:len(pair)])
    return pair[first], np.add.reduceat(np.concatenate(counts)[order], first)


class PairDocuments:
    """Distinct pairs of the texts added, with the number of texts that hold each."""

    def __init__(self):
        self.pairs, self.counts, self.held = [], [], 0

    def _add(self, pair: np.ndarray, count: np.ndarray) -> None:
        self.pairs.append(pair)
        self.counts.append(count)
        self.held += len(pair)
        if self.held > max(HELD_PAIRS, len(self.pairs[0]) // 2):  # new ones; so each is sorted a few times
            self.pairs, self.counts = ([x] for x in _summed(self.pairs, self.counts))
            self.held = 0

    def add(self, found: Iterator[Groups]) -> None:
        long_owner, long_pairs = None, np.empty(0, np.int64)
        for groups in found:
            if len(long_pairs) and groups.owner[0] != long_owner:
                self._add(long_pairs, np.ones(len(long_pairs), np.int64))
                long_pairs = np.empty(0, np.int64)
            owners, pairs = [], []
            for owner, pair, _ in groups.links():
                distinct, place = np.unique(pair, return_inverse=True)
                code = np.unique(owner * len(distinct) + place)
                owners.append(code // len(distinct))
                pairs.append(distinct[code % len(distinct)])
            owner, pair = np.concatenate(owners), np.concatenate(pairs)
            if groups.owner[0] == groups.owner[-1]:  # maybe one round of several for this text
                long_owner, long_pairs = groups.owner[0], np.union1d(long_pairs, pair)
                continue
            if len(owners) > 1:
                distinct, place = np.unique(pair, return_inverse=True)
                pair = distinct[np.unique(owner * len(distinct) + place) % len(distinct)]
            self._add(*np.unique(pair, return_counts=True))
        if len(long_pairs):
            self._add(long_pairs, np.ones(len(long_pairs), np.int64))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.pairs, self.counts) if self.pairs else (np.empty(0, np.int64),) * 2


BATCHES = ("batch long, place long, doc_ids array<long>, sizes binary, ids binary, block int, pairs binary, "
           "counts binary")


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = {"batch": pa.int64(), "place": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.binary(),
             "ids": pa.binary(), "block": pa.int32(), "pairs": pa.binary(), "counts": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * n), k) for c, k in kinds.items()], list(kinds))


def batch_writer(byte_path: str, piece_path: str, batch_bytes: int, blocks: int):
    """Encoded documents, about ``CHUNK_BYTES`` of text a row, in batches, and each batch's pairs as one
    row per block."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers.of_worker(byte_path, piece_path)
        batch, place, size, held = TaskContext.get().partitionId() << 32, 0, 0, PairDocuments()

        def pair_rows() -> Iterator[pa.RecordBatch]:
            pair, count = held.result()
            block = (pair >> 32) % blocks
            order = np.argsort(block, kind="stable")
            edges = np.searchsorted(block[order], np.arange(blocks + 1))
            own = [b for b in range(blocks) if edges[b] < edges[b + 1]]
            if own:
                yield _batch(batch=[batch] * len(own), block=own,
                             pairs=[pair[order[edges[b]:edges[b + 1]]].astype("<i8").tobytes() for b in own],
                             counts=[count[order[edges[b]:edges[b + 1]]].astype("<i8").tobytes() for b in own])

        for part in by_size(batches, CHUNK_BYTES):
            nbytes = part.column("text").nbytes
            if size and size + nbytes > batch_bytes:
                yield from pair_rows()
                batch, place, size, held = batch + 1, 0, 0, PairDocuments()
            encoded = tokenizers.encode(part.column("text").to_pylist())
            held.add(rounds(tokenizers, encoded))
            sizes, ids = stored(encoded)
            yield _batch(batch=[batch], place=[place], doc_ids=[part.column("doc_id").to_pylist()],
                         sizes=[sizes], ids=[ids])
            place, size = place + 1, size + nbytes
        yield from pair_rows()
    return write


def streamed(rows: DataFrame, keys: list[str], order: list, run: Callable, schema: str) -> DataFrame:
    """``run`` over partitions in which rows of equal keys follow each other in the order asked for."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def _i8(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def key_merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each (block, part)."""
    at, held, size = None, [], 0

    def flush() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([at[0]], pa.int32()), "part": pa.array([at[1]], pa.int64()),
            "pairs": pa.array([keys.astype("<i8").tobytes()], pa.binary())})

    for row in _rows(batches):
        if (row["block"], row["part"]) != at:
            if at:
                yield flush()
            at, held, size = (row["block"], row["part"]), [], 0
        held.append(_i8(row["pairs"]))
        size += len(held[-1])
        if size > 1 << 21:
            held = [np.unique(np.concatenate(held))]
            size = len(held[0]) // 2
    if at:
        yield flush()


HASHES = "block int, levels array<binary>, keys binary"


def hash_builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The perfect hash of each block, with its pairs by slot."""
    for row in _rows(batches):
        pairs = _i8(row["pairs"])
        levels = build(pairs)
        keys = np.empty_like(pairs)
        keys[PerfectHash(levels).slots(pairs)] = pairs
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([row["block"]], pa.int32()),
            "levels": pa.array([levels], pa.list_(pa.binary())), "keys": pa.array([keys.tobytes()])})


def _slots(table: dict, hashed: PerfectHash, pairs: np.ndarray) -> np.ndarray:
    """Verified slots of pairs that are all in the table."""
    slot, keys = hashed.slots(pairs), _i8(table["keys"])
    if not (keys[slot] == pairs).all():
        raise RuntimeError("a pair is missing from its block")
    return slot


def vector_adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (block, part) the dense vector of its batches' numbers; the block's hash is its first row."""
    table, hashed, total, at = None, None, None, None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([at[0]], pa.int32()), "part": pa.array([at[1]], pa.int64()),
            "counts": pa.array([total.tobytes()], pa.binary())})

    for row in _rows(batches):
        if row["levels"] is not None:
            if at:
                yield flush()
            table, hashed, at = row, PerfectHash(row["levels"]), (row["block"], row["part"])
            total = np.zeros(hashed.size, "<i8")
        else:
            total[_slots(table, hashed, _i8(row["pairs"]))] += _i8(row["counts"])
    if at:
        yield flush()


def vector_summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level of the tree: the sum of the vectors of each (block, part)."""
    at, total = None, None
    for row in _rows(batches):
        if (row["block"], row["part"]) != at:
            if at:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([at[0]], pa.int32()), "part": pa.array([at[1]], pa.int64()),
                    "counts": [total.tobytes()]})
            at, total = (row["block"], row["part"]), _i8(row["counts"]).copy()
        else:
            total += _i8(row["counts"])
    if at:
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([at[0]], pa.int32()), "part": pa.array([at[1]], pa.int64()),
            "counts": [total.tobytes()]})


ANSWERS = "batch long, pairs binary, counts binary, best binary"


def answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each batch's pairs, and which are the highest of their first id."""
    table, hashed, counts, best = None, None, None, None
    for row in _rows(batches):
        if row["levels"] is not None:
            table, hashed, counts = row, PerfectHash(row["levels"]), _i8(row["counts"])
            first = _i8(row["keys"]) >> 32
            highest = np.zeros(int(first.max()) + 1, np.int64)
            np.maximum.at(highest, first, counts)
            best = counts == highest[first]
            continue
        slot = _slots(table, hashed, _i8(row["pairs"]))
        yield pa.RecordBatch.from_pydict({
            "batch": pa.array([row["batch"]], pa.int64()), "pairs": [row["pairs"]],
            "counts": [counts[slot].tobytes()], "best": [best[slot].tobytes()]})


ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string, groups string")


def second_pass(byte_path: str, piece_path: str, keep_groups: bool):
    """Per document the sizes of its alignment and what the counts say of its links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers.of_worker(byte_path, piece_path)
        tokenizers.words.forget()  # texts are not encoded again
        at, answers, known = None, [], None

        def aligned(doc_ids: list[int | None], encoded: Encoded) -> pa.RecordBatch:
            facts = np.zeros((6, len(doc_ids)), np.int64)
            digests = [hashlib.sha256() for _ in doc_ids]
            texts: list[list[str]] = [[] for _ in doc_ids]
            for groups in rounds(tokenizers, encoded):
                for i, values in enumerate((groups.n_a, groups.n_b, 1, groups.n_a * groups.n_b)):
                    np.add.at(facts[i], groups.owner, values)
                for owner, pair, times in groups.links():
                    distinct, place = np.unique(pair, return_inverse=True)
                    where = np.minimum(np.searchsorted(known[0], distinct), len(known[0]) - 1)
                    if not (known[0][where] == distinct).all():
                        raise RuntimeError("a pair of the second pass was not counted in the first")
                    np.add.at(facts[4], owner, times * known[2][where][place])
                    np.add.at(facts[5], owner, times * known[1][where][place])
                for owner, written in groups.written():
                    if texts[owner]:  # of an earlier round
                        digests[owner].update(b";")
                    digests[owner].update(written[:-1].encode())
                    texts[owner].append(written[:-1] if keep_groups else "")
            columns = [pa.array(doc_ids, pa.int64()), *map(pa.array, facts),
                       pa.array([d.hexdigest() if t else "" for d, t in zip(digests, texts)], pa.string()),
                       pa.array([";".join(t) if keep_groups else None for t in texts], pa.string())]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ALIGNED.split(", ")])

        for row in _rows(batches):
            if row["batch"] != at:
                at, answers, known = row["batch"], [], None
            if row["place"] is None:
                answers.append(row)
                continue
            if known is None:
                parts = [np.concatenate([np.frombuffer(x[c], kind) for x in answers] or [np.empty(0, kind)])
                         for c, kind in (("pairs", "<i8"), ("counts", "<i8"), ("best", bool))]
                order = np.argsort(parts[0])
                known, answers = [p[order] for p in parts], []
            yield aligned(row["doc_ids"], restored(len(row["doc_ids"]), row["sizes"], row["ids"]))
    return run


class PairTable:
    """The stored batches, and the counted pairs of all documents by block."""

    def __init__(self, spark: SparkSession, docs: DataFrame, byte_path: str, piece_path: str,
                 batch_bytes: int = BATCH_BYTES, blocks: int = BLOCKS, fan_in: int = FAN_IN):
        self.paths = byte_path, piece_path
        self.stages = stages = Stages(spark, "alignment", "zstd")
        self.batches = stages.write("batches", docs.select("doc_id", "text").mapInArrow(
            batch_writer(byte_path, piece_path, batch_bytes, blocks), BATCHES))
        self.pairs = self.batches.where(F.col("block").isNotNull()).select("batch", "block", "pairs", "counts")
        most = self.pairs.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        self.parts = -(-most // fan_in)  # of a block, so that one adds up about fan_in batches
        self.fan_in = fan_in
        self.hashes = stages.write("hashes", self._keys().mapInArrow(hash_builder, HASHES))
        self.table = stages.write("table", self._counted())

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64("batch"), F.lit(max(parts, 1))).cast("long")

    def _keys(self) -> DataFrame:
        """(block, pairs): each distinct pair of the corpus once, merged in a tree."""
        rows, parts = self.pairs.select("block", self._part(self.parts).alias("part"), "pairs"), self.parts
        while True:
            rows = streamed(rows, ["block", "part"], [], key_merger, "block int, part long, pairs binary")
            if parts <= 1:
                return rows
            parts = -(-parts // self.fan_in)
            rows = rows.withColumn("part", F.pmod("part", F.lit(parts)))

    def _with_batches(self, table: DataFrame, columns: list[str]) -> DataFrame:
        """Rows of the block table, once for each part of the block, above the batches' rows."""
        spread = table.withColumn("part", F.explode(F.sequence(
            F.lit(0).cast("long"), F.lit(max(self.parts, 1) - 1).cast("long"))))
        batches = self.pairs.withColumn("part", self._part(self.parts))
        return spread.unionByName(batches.select("block", "part", *columns), allowMissingColumns=True)

    def _counted(self) -> DataFrame:
        """(block, levels, keys, counts)."""
        first = [F.col("levels").isNull()]
        vectors = streamed(self._with_batches(self.hashes, ["pairs", "counts"]), ["block", "part"], first,
                           vector_adder, "block int, part long, counts binary")
        parts = self.parts
        while parts > 1:
            parts = -(-parts // self.fan_in)
            vectors = streamed(vectors.withColumn("part", F.pmod("part", F.lit(parts))), ["block", "part"], [],
                               vector_summer, "block int, part long, counts binary")
        return self.hashes.join(vectors.drop("part"), "block")

    def pair_counts(self) -> DataFrame:
        """(a_id, b_id, n_docs) of every linked pair."""
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                pairs, counts = _i8(row["keys"]), _i8(row["counts"])
                for i in range(0, len(pairs), 100_000):
                    some = pairs[i:i + 100_000]
                    yield pa.RecordBatch.from_pydict({
                        "a_id": pa.array(some >> 32), "b_id": pa.array(some & 0xFFFFFFFF),
                        "n_docs": pa.array(counts[i:i + 100_000])})
        return self.table.select("keys", "counts").mapInArrow(unpack, "a_id long, b_id long, n_docs long")

    def aligned(self, keep_groups: bool = False) -> DataFrame:
        """One row per document; ``groups`` is the text form of its groups if asked for."""
        asked = self._with_batches(self.table, ["batch", "pairs"])
        answers = self.stages.write("answers", streamed(
            asked, ["block", "part"], [F.col("levels").isNull()], answerer, ANSWERS))
        docs = self.batches.where(F.col("place").isNotNull()).select("batch", "place", "doc_ids", "sizes", "ids")
        rows = docs.unionByName(answers, allowMissingColumns=True)
        out = streamed(rows, ["batch"], [F.col("place").asc_nulls_first()],
                       second_pass(*self.paths, keep_groups), ALIGNED)
        return out if keep_groups else out.drop("groups")
