"""Language identification by cross-parsing entropy.

Per language the suffix automaton of some labelled text is built; it accepts every substring of
that text. A document is parsed, from left to right, into the longest phrases the automaton accepts,
and the language that needs the fewest phrases per letter wins: the entropy of the document relative
to that language is smallest. Letters are lower-cased, runs of other characters are one space. A text
is one parse: its blocks of ``BLOCK`` letters are steps of one numpy walk and then joined by their states.

Learning takes a bounded sample: ``SAMPLE_ROWS`` labelled rows per language by hash, up to
``SAMPLE_LETTERS`` letters of them, and ``ALL_LETTERS`` over all languages, which share them equally.
The automata are sent to the workers; their size is bounded by that.

Cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was
learned; ties go to the language that sorts first; letters no language has are phrases of their own
(letters beyond the ``OWN_CLASSES`` commonest of all languages share ``SHARED`` classes by code point);
repeated rows and null ids are predicted like others, but one text of an id (the first in order) is
learned from, and none of a null id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.common import by_size, worker_cache

SAMPLE_ROWS, SAMPLE_LETTERS, ALL_LETTERS = 64, 40_000, 400_000
BLOCK = 512
#: Letters within which two walks of a block usually meet.
MEETING = 64
#: Letters of a piece of training text that is kept or left out as a whole.
SEGMENT = 256
#: Letters with a class of their own; all others share ``SHARED`` classes by code point.
OWN_CLASSES, SHARED = 96, 16
GROUP_CHARS = 1 << 20
NEXT = (1 << 28) - 1
UNDETERMINED = "und"
PREDICTED = (T.StructType().add("lang_pred", "string").add("score", "double")
             .add("phrases_per_letter", "double"))


def labelled_sample(docs: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """Up to ``rows`` texts per language, chosen by a hash of the id."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.col("n"))
    few = known.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(
        place < 2 * rows + 16).select("doc_id", "lang").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id")
    chosen = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    texts = known.select("doc_id", "lang", F.substring("text", 1, SAMPLE_LETTERS).alias("text")).join(
        F.broadcast(chosen.select("doc_id", "lang", "rank")), ["doc_id", "lang"])
    found: dict[str, list[str]] = {}
    for row in texts.groupBy("lang", "rank").agg(F.min("text").alias("text")).orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["text"])
    return found


def suffix_automaton(letters: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start, and every path from it is a substring."""
    goes, link, length, last = [{}], [-1], [0], 0
    for c in letters:
        new = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = new
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goes


class Letters:
    """The class of every code point: 0 for what is no letter."""

    def __init__(self, classes: np.ndarray, count: int):
        self.classes, self.count = classes, count

    @classmethod
    def seen_in(cls, texts: list[str]) -> Letters:
        seen = Counter(c for text in texts for c in text.lower() if c.isalpha())
        classes = np.zeros(0x110000, np.uint8)
        points = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        own = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:OWN_CLASSES]]
        classes[points] = 1 + len(own) + points % SHARED
        for k, c in enumerate(own):
            classes[ord(c)] = 1 + k
        return cls(classes, 1 + len(own) + SHARED)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the letters and single spaces of all texts, and the text each belongs to."""
        texts = [t.lower() for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        kind = self.classes[points]
        space = kind == 0
        first = np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)]
        after_space = np.concatenate([[False], space[:-1]])[:len(doc)] | first
        keep = ~(space & after_space)
        return kind[keep], doc[keep]


def automaton_table(goes: list[dict[int, int]], classes: int) -> np.ndarray:
    """Next state by state and class; the bits above count the phrases that end before the letter."""
    table = np.zeros((len(goes), classes), np.int32)
    root = np.full(classes, 2 << 28, np.int32)  # no phrase holds it: it is one itself
    for c, to in goes[0].items():
        root[c] = to | 1 << 28
    table[:] = root
    for state, step in enumerate(goes):
        for c, to in step.items():
            table[state, c] = to
    return table.ravel()


def phrase_counts(kinds: np.ndarray, doc: np.ndarray, n: int, table: np.ndarray, classes: int) -> np.ndarray:
    """Phrases of each of ``n`` documents under one automaton, each parsed as a whole.

    All blocks are first walked from the start of a phrase. A block that follows another one is then
    walked from the state that one ends in, until both walks are in one state, from where they are
    one; if they do not meet soon, to its end, and if it ends in another state than before, its
    follower is walked anew.
    """
    sizes = np.bincount(doc, minlength=n)
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(n), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = (np.cumsum(sizes) - sizes)[owner] + nth * BLOCK
    length = np.minimum(sizes[owner] - nth * BLOCK, BLOCK)
    by_length = np.argsort(-length, kind="stable")
    states = np.zeros((MEETING, len(owner)), np.int32)
    counts = np.zeros((MEETING, len(owner)), np.int64)

    def walk(some: np.ndarray, state: np.ndarray, steps: int, each=None) -> tuple[np.ndarray, np.ndarray]:
        """Last states and counts of blocks that are given longest first."""
        state, count, active = state.copy(), np.zeros(len(some), np.int64), len(some)
        for j in range(min(steps, int(length[some[0]]) if active else 0)):
            while active and length[some[active - 1]] <= j:
                active -= 1
            to = table[state[:active] * classes + kinds[starts[some[:active]] + j]]
            count[:active] += to >> 28
            state[:active] = to & NEXT
            if each:
                each(j, active, state, count)
        return state, count

    def keep(j: int, active: int, state: np.ndarray, count: np.ndarray) -> None:
        if j < MEETING:
            states[j, by_length[:active]], counts[j, by_length[:active]] = state[:active], count[:active]

    ends, totals = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64)
    ends[by_length], totals[by_length] = walk(by_length, np.zeros(len(owner), np.int32), BLOCK, keep)
    first_ends, first_totals = ends.copy(), totals.copy()
    todo = by_length[nth[by_length] > 0]
    while len(todo):
        entry = ends[todo - 1]
        met, total = np.zeros(len(todo), bool), np.zeros(len(todo), np.int64)

        def meet(j: int, active: int, state: np.ndarray, count: np.ndarray) -> None:
            some = todo[:active]
            new = ~met[:active] & (state[:active] == states[j, some])
            total[:active][new] = (count[:active] + first_totals[some] - counts[j, some])[new]
            met[:active] |= new
        walk(todo, entry, MEETING, meet)
        before = ends[todo]
        ends[todo[met]], totals[todo[met]] = first_ends[todo[met]], total[met]
        apart = todo[~met]
        ends[apart], totals[apart] = walk(apart, entry[~met], BLOCK)
        after = todo[ends[todo] != before] + 1
        after = after[after < len(owner)]
        after = after[nth[after] > 0]
        todo = after[np.argsort(-length[after], kind="stable")]
    return np.bincount(owner, totals, n) + (sizes > 0)


def _tables(segments: dict[str, list[np.ndarray]], classes: int) -> dict[str, np.ndarray]:
    most = min(SAMPLE_LETTERS, ALL_LETTERS // max(len(segments), 1))
    return {lang: automaton_table(suffix_automaton(
        np.concatenate(parts)[:most].tolist() if parts else []), classes)
        for lang, parts in sorted(segments.items())}


def learn(samples: dict[str, list[str]]) -> tuple[Letters, dict[str, np.ndarray]]:
    """Letter classes and one table per language.

    Labels hold for documents, which may quote another language. So each sampled document gives
    segments, those of every other document are parsed by automata of the rest, and segments that
    another language parses better are left out.
    """
    letters = Letters.seen_in([t for texts in samples.values() for t in texts])
    share = 2 * SAMPLE_LETTERS // SAMPLE_ROWS
    halves: list[dict[str, list[np.ndarray]]] = [{}, {}]
    for lang, texts in samples.items():
        for i, text in enumerate(texts):
            kinds = letters.of([text])[0][:share]
            halves[i % 2].setdefault(lang, []).extend(
                kinds[a:a + SEGMENT] for a in range(0, len(kinds), SEGMENT))
    kept: dict[str, list[np.ndarray]] = {lang: [] for lang in samples}
    for own, other in (halves, halves[::-1]):
        tables = _tables(other, letters.count)
        for lang, segments in own.items():
            if lang not in tables or not segments:
                kept[lang] += segments
                continue
            doc = np.repeat(np.arange(len(segments)), [len(x) for x in segments])
            phrases = {k: phrase_counts(np.concatenate(segments), doc, len(segments), t, letters.count)
                       for k, t in tables.items()}
            least = np.min(list(phrases.values()), 0)
            kept[lang] += [x for x, fits in zip(segments, phrases[lang] == least) if fits]
    return letters, _tables(kept, letters.count)


def predictor(model, carry: list[str]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("cross_parsing")
        (classes, count), tables = model.value
        letters = Letters(classes, count)
        langs = list(tables)
        for batch in by_size(batches):
            texts, at = batch.column("text").to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= GROUP_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                n = end - at
                kinds, doc = letters.of([t or "" for t in texts[at:end]])
                count = np.bincount(doc, minlength=n)
                lettered = np.bincount(doc, kinds > 0, n) > 0
                phrases = np.array([phrase_counts(kinds, doc, n, tables[k], letters.count)
                                    for k in langs]).reshape(len(langs), n)
                known = lettered & (len(langs) > 0)
                best = phrases.argmin(0) if langs else np.zeros(n, int)
                least = phrases.min(0) if langs else np.zeros(n)
                score = 1 / np.exp(np.maximum(least - phrases, -50) / 2).sum(0) if langs else np.zeros(n)
                found = (
                    pa.array([langs[b] if k else UNDETERMINED for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                    pa.array(np.where(known, least / np.maximum(count, 1), 0.0)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, n) for c in carry), *found],
                    [*carry, "lang_pred", "score", "phrases_per_letter"])
                at = end
    return predict


def identify(spark: SparkSession, docs: DataFrame, learn_from: Column,
             carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred, score and phrases_per_letter of every row.

    ``learn_from`` marks the rows whose ``lang`` may be learned from.
    """
    letters, tables = learn(labelled_sample(docs.select("doc_id", "text", "lang"), learn_from))
    model = spark.sparkContext.broadcast(((letters.classes, letters.count), tables))
    schema = T.StructType([docs.schema[c] for c in carry] + PREDICTED.fields)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(predictor(model, list(carry)), schema)
