"""Toxicity by a weighted finite-state grammar over the words of a clause.

Small transducers read the classes of a clause's words: insults, threats, targets, negations and
reported speech. Their composition is one transducer whose states are products of theirs and whose
weights are products of their weights. A path through it picks one insult or threat of the clause as
its head; the clause's weight is the sum over all accepted paths. Insults are stems learned from
labelled rows, with their log odds as weight. An insult is accepted where other words say what it is
about, and weighs more beside a named target; a clause of nothing but insults is no match. A threat is
accepted only beside a named target. A negation up to ``REACH`` words away, or a verb of reported
speech anywhere in the clause, lowers the weight, whether it stands before the head or behind it. A
document's score is a logistic function of its clauses' weights, fitted on the labelled rows.

Learning takes at most ``SAMPLE_ROWS`` labelled rows, by a hash of the id, and the model holds at most
``MAX_STEMS`` beginnings, the shortest and best attested first.

Cases: null and empty texts, and texts without a match, have no weight and get the score of the
intercept; rows without a label are scored only; without labelled rows of both kinds nothing is
learned, and only threats and the prior score; repeated rows and null ids are scored like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import by_size

SAMPLE_ROWS = 12_000
SHORTEST, LONGEST = 3, 8
MIN_ODDS, MIN_EVIDENCE, MIN_DOCS = 2.5, 20.0, 3
MAX_STEMS = 2_000

#: Fixed word classes of the grammar.
THREATS = "kill hurt destroy murder burn shoot töten umbringen vernichten tuer détruire matar destruir".split()
TARGETS = ("you your yours he she him her they them these those people du dich dir ihr euch sie "
           "tu toi te vous votre ils elles usted ustedes ellos ellas tú ti").split()
NEGATIONS = "not no never neither nor isn't aren't nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = ("said says wrote writes quoted quotes called claimed reported sagte schrieb dit écrit "
           "dijo escribió").split()
#: How far a negation reaches, in words, and what the transducers multiply a weight by.
REACH = 4
WITH_TARGET, NEGATED, REPORTED, THREAT_WEIGHT = 1.25, 0.4, 0.6, 2.0

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n]+")
FEATURES = ("weight", "strongest", "clauses", "density")


def clauses(text: str) -> list[str]:
    """The clauses of a text. A single word between marks calls or exclaims: it belongs to the words that
    follow, and the last one of a text to those before."""
    out, waiting, n = [], [], 0
    for part in CLAUSE.split(text):
        waiting.append(part)
        n += sum(1 for _ in islice(WORD.finditer(part), 2))
        if n > 1:
            out.append(" ".join(waiting))
            waiting, n = [], 0
    if n:
        out[-1:] = [" ".join([*out[-1:], *waiting])]
    return out


def stems_of(text: str) -> set[str]:
    """Beginnings of the words of a text, marked with a star, and its whole words."""
    words = set(WORD.findall(text.lower()))
    return {w[:k] for w in words for k in range(SHORTEST, LONGEST + 1) if len(w) >= k}


def stem_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches):
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            counts[toxic].update(stems_of(text or ""))
        rows = [(s, counts[1][s], counts[0][s]) for s in counts[0].keys() | counts[1].keys()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3,
                                            (pa.string(), pa.int64(), pa.int64()))],
            ["stem", "toxic", "clean"])


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Insult stems with their log odds; the shortest beginning that tells stands for its longer ones."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    both, share = a + b, toxic / (toxic + clean)
    evidence = 2 * (a * F.log(a / (both * share))
                    + F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0))
    counts = sample.select("text", "toxic").mapInArrow(
        stem_counter, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.where(a >= MIN_DOCS).select("stem", odds.alias("odds"), evidence.alias("evidence")).where(
        (F.col("odds") >= MIN_ODDS) & (F.col("evidence") >= MIN_EVIDENCE))
    best = found.orderBy(F.length("stem"), F.col("evidence").desc(), "stem").limit(MAX_STEMS).collect()
    stems: dict[str, float] = {}
    for row in best:
        if not any(row["stem"][:k] in stems for k in range(SHORTEST, len(row["stem"]))):
            stems[row["stem"]] = row["odds"]
    return stems


#: Classes a word is read as; a path reads its head as ``head``.
WORD_CLASSES = ("insult", "threat", "target", "negation", "report", "other")


@dataclass(frozen=True)
class Transducer:
    """Arcs by state and class; a class without an arc stays in its state, one to None has no path."""
    start: object
    arcs: dict
    ends: dict

    def step(self, state, kind: str):
        return self.arcs.get((state, kind), state)


def compose(*parts: Transducer) -> Transducer:
    """The transducer that reads what all parts read; states are products, and so are weights."""
    start = tuple(p.start for p in parts)
    arcs, ends, open_states, seen = {}, {}, [start], {start}
    while open_states:
        state = open_states.pop()
        if all(s in p.ends for p, s in zip(parts, state)):
            ends[state] = math.prod(p.ends[s] for p, s in zip(parts, state))
        for kind in (*WORD_CLASSES, "head"):
            after = tuple(p.step(s, kind) for p, s in zip(parts, state))
            arcs[state, kind] = None if None in after else after
            if None not in after and after not in seen:
                seen.add(after)
                open_states.append(after)
    return Transducer(start, arcs, ends)


def negations(reach: int = REACH) -> Transducer:
    """Counts words from a negation to the head, and from the head to a negation."""
    arcs = {}
    for left in range(reach, 0, -1):
        for kind in WORD_CLASSES:
            arcs[("before", left), kind] = ("before", left - 1)
            arcs[("behind", left), kind] = ("behind", left - 1)
        arcs[("before", left), "head"] = "negated"
        arcs[("behind", left), "negation"] = "negated"
    for left in range(reach + 1):
        arcs[("before", left), "negation"] = ("before", reach)
    arcs[("before", 0), "head"] = ("behind", reach)
    return Transducer(("before", 0), arcs,
                      {"negated": NEGATED} | {("behind", left): 1.0 for left in range(reach + 1)})


#: One word is the head.
HEAD = Transducer("open", {("open", "head"): "found", ("found", "head"): None}, {"found": 1.0})
#: What an insult is about: a named target, or something that other words of the clause say.
INSULTED = Transducer(
    "nothing", {("nothing", "other"): "something", ("nothing", "threat"): "something",
                ("nothing", "target"): "named", ("something", "target"): "named"},
    {"something": 1.0, "named": WITH_TARGET})
THREATENED = Transducer("nothing", {("nothing", "target"): "named"}, {"named": 1.0})
REPORTED_SPEECH = Transducer("direct", {("direct", "report"): "reported"}, {"direct": 1.0, "reported": REPORTED})
PATTERNS = {"insult": compose(HEAD, INSULTED, negations(), REPORTED_SPEECH),
            "threat": compose(HEAD, THREATENED, negations(), REPORTED_SPEECH)}


def path_sum(pattern: Transducer, head: str, words: list[tuple[str, float]]) -> float:
    """The weights of all accepted paths over the words, summed; paths in one state go on together."""
    live = {pattern.start: 1.0}
    for kind, value in words:
        after = defaultdict(float)
        for state, weight in live.items():
            after[pattern.arcs[state, kind]] += weight
            if kind == head:
                after[pattern.arcs[state, "head"]] += weight * value
        after.pop(None, None)
        live = after
    return sum(weight * pattern.ends.get(state, 0.0) for state, weight in live.items())


class Grammar:
    """The classes of words, and the weight of what a clause of them matches."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.word = {w: kind for kind, words in (("target", TARGETS), ("negation", NEGATIONS),
                                                 ("report", REPORTS)) for w in words}
        self.threats = set(THREATS)
        starts = sorted([*stems, *THREATS], key=len, reverse=True)
        self.any = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, starts))})")

    def classify(self, word: str) -> tuple[str, float]:
        if word in self.word:
            return self.word[word], 0.0
        if word in self.threats:
            return "threat", THREAT_WEIGHT
        for k in range(SHORTEST, min(len(word), LONGEST) + 1):
            if word[:k] in self.stems:
                return "insult", self.stems[word[:k]]
        return "other", 0.0

    def clause(self, text: str) -> float:
        if not self.any.search(text):
            return 0.0
        words = [self.classify(w) for w in WORD.findall(text)]
        heads = {kind for kind, _ in words}
        return sum(path_sum(pattern, head, words) for head, pattern in PATTERNS.items() if head in heads)

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        if not self.any.search(low):
            return [0.0] * len(FEATURES)
        weights = [w for w in map(self.clause, clauses(low)) if w > 0]
        total = sum(weights)
        return [math.log1p(total), math.log1p(max(weights, default=0.0)), math.log1p(len(weights)),
                math.log1p(1000 * total / (len(low) + 100))]


def featurizer(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.value)
        for batch in by_size(batches):
            rows = np.array([grammar.features(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(c) for c in rows.reshape(-1, len(FEATURES)).T)],
                [*keep, *FEATURES])
    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept by Newton steps, with a ridge on the weights."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9),
                               x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn_from: Column) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; learns from the labelled rows marked."""
    docs = docs.select("doc_id", "text")
    known = labels.where(learn_from & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(SAMPLE_ROWS)
    sample = docs.join(F.broadcast(chosen), "doc_id")
    stems = spark.sparkContext.broadcast(learn_stems(sample))
    run = "weight double, strongest double, clauses double, density double"
    training = sample.select("toxic", "text").mapInArrow(featurizer(stems, ["toxic"]), f"toxic int, {run}")
    rows = np.array([list(r) for r in training.collect()], float).reshape(-1, 1 + len(FEATURES))
    w = fit_logistic(rows[:, 1:], rows[:, 0]) if len(rows) else np.array([1.0, 0, 0, 0, -2.0])
    line = sum((F.col(c) * float(v) for c, v in zip(FEATURES, w)), F.lit(float(w[-1])))
    scored = docs.mapInArrow(featurizer(stems, ["doc_id"]), f"doc_id long, {run}").select(
        "doc_id", (1 / (1 + F.exp(-line))).alias("score"), *FEATURES)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
