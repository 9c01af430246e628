"""Personal data by weak supervision, with DataFrame functions only.

Four base kinds (email, ip, card, phone) are fixed patterns with checks; their spans always stay.
Three more kinds (secret, number, handle) are found by wide patterns as candidates, which labelers
vote on: regular expressions on the shape, gazetteers of known beginnings and of placeholders, and
the words before the span. Expectation-maximisation over the vote patterns (their counts, at most
3 to the power of the labelers, are all that reaches the driver) estimates how reliable each labeler
is and how likely each pattern is personal data. Those probabilities train a naive Bayes classifier
on the shape and context of a span, which decides; its weights are a column expression.

Positions are code points, ends exclusive. Matches of one kind are leftmost and do not overlap; a
match that fails its check is dropped without another try; a candidate that overlaps a base span or
a candidate of a kind before it is dropped.

Cases: a null text is empty and has no span; repeated rows and null ids are rows of their own; without
candidates nothing is learned or added; an empty table gives an empty result; other columns of the
input are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import Stages

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["secret", "number", "handle"]
KINDS = BASE_KINDS + ADDED_KINDS

#: What has to stand in a text for a kind to be searched at all, and the pattern of the kind. The
#: repetitions never give back, and a match begins where its first run of characters does, so that
#: the time is linear in the text.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": (r"[0-9][A-Za-z]|[A-Za-z][0-9]",
               r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"),
    "number": (r"[0-9](?:[\x20-]?[0-9]){8}", r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9]){8,}+"),
    "handle": (r"(?i)[\[(]at[\])]", r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[(]at[\])] ?[a-z0-9-]++"
                                    r"(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++"),
}
#: Gazetteers: how credentials of well-known services begin, and words of examples.
KNOWN_BEGINNINGS = "AKIA ghp_ gho_ github_pat_ glpat- sk_live_ sk- xoxb- xoxp- eyJ AIza".split()
PLACEHOLDERS = "example sample test dummy placeholder lorem xxxx 12345678 00000000".split()
PRIVATE_WORDS = ("token secret password passwd pwd key auth credential card account acct iban contact "
                 "mail e-mail phone tel call konto passwort clave cuenta compte").split()
PUBLIC_WORDS = "version isbn issn license licence copyright page chapter section doi commit".split()
CONTEXT_CHARS = 24
LABELERS = ["shape", "variety", "gazetteer", "private_words", "public_words", "assigned"]
TRAITS = ["kind", "length", "digits", "variety_of", "context", "before"]
EM_ROUNDS, SMOOTHING, THRESHOLD = 40, 0.5, 0.5
BLOCK = 256

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _sums_before(lengths: Column) -> Column:
    """Prefix sums of an array in two levels of ``BLOCK``, each entry without itself."""
    def of(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")),
                             lambda b: _total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        return let(blocks, lambda t: let(
            F.transform(t, lambda _, b: _total(F.slice(t, F.lit(1), b))),
            lambda base: F.transform(n, lambda _, i: base[F.floor(i / BLOCK).cast("int")] + _total(
                F.slice(n, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), (i % BLOCK).cast("int"))))))
    return let(lengths, of)


def matches(text: Column, kind: str) -> Column:
    """All leftmost matches of a kind as spans with their values.

    The parts between the matches give their positions.
    """
    needed, pattern = PATTERNS[kind]
    has = F.contains(text, F.lit(needed)) if needed == "@" else text.rlike(needed)

    def spans(values: Column) -> Column:
        between = F.split(text, pattern, -1)
        lengths = let(between, lambda p: F.transform(values, lambda v, i: F.length(p[i]) + F.length(v)))
        return let(F.struct(_sums_before(lengths).alias("at"), lengths.alias("n")), lambda x: F.transform(
            values, lambda v, i: F.struct(
                (x["at"][i] + x["n"][i] - F.length(v)).cast("int").alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (x["at"][i] + x["n"][i]).cast("int").alias("end"), F.lit(kind).alias("kind"), v.alias("value"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda v: F.when(F.size(v) > 0, spans(v)).otherwise(F.array().cast(SPAN)))
    return F.when(has, found).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str) -> Callable[[Column], Column]:
    """The check of a kind on a span."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return lambda s: s["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return lambda s: let(_digits(s["value"]), lambda d: F.when(
            F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(9, 15)
    return lambda s: F.lit(True)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return let(others, lambda o: F.filter(spans, lambda s: ~F.exists(
        o, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))))


def _words(words: list[str]) -> str:
    return "(?i)(?:" + "|".join(words) + ")"


def _vote(condition: Column, yes: int, otherwise: Column | int = 0) -> Column:
    return F.when(condition, yes).otherwise(otherwise)


def labelled(text: Column, spans: Column) -> Column:
    """Spans with a vote of each labeler and the traits the classifier reads."""
    def of(s: Column) -> Column:
        value, start = s["value"], s["start"]
        return let(F.struct(
            F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1,
                        F.least(start, F.lit(CONTEXT_CHARS))).alias("context"),
            F.length(_digits(value)).alias("digits"), F.length(value).alias("length"),
            F.size(F.array_distinct(F.split(F.lower(value), ""))).alias("variety")), lambda x: describe(s, x))

    def describe(s: Column, x: Column) -> Column:
        value, n, digits, variety = s["value"], x["length"], x["digits"], x["variety"]
        known = value.rlike("^(?:" + "|".join(KNOWN_BEGINNINGS) + ")")
        private, public = x["context"].rlike(_words(PRIVATE_WORDS)), x["context"].rlike(_words(PUBLIC_WORDS))
        before = F.regexp_extract(x["context"], r"""([="':(]|)[\x20"']{0,2}$""", 1)
        return F.struct(
            s["start"], s["rank"], s["end"], s["kind"], value.alias("value"),
            _vote((s["kind"] == "handle") | value.rlike(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
                  | ((s["kind"] == "number") & digits.between(13, 19)), 1,
                  _vote((s["kind"] == "number") & (digits < 11), -1)).alias("shape"),
            _vote(variety >= 9, 1, _vote(variety <= 4, -1)).alias("variety"),
            _vote(known, 1, _vote(value.rlike(_words(PLACEHOLDERS)), -1)).alias("gazetteer"),
            _vote(private, 1).alias("private_words"), _vote(public, -1).alias("public_words"),
            _vote(before != "", 1).alias("assigned"),
            F.least(F.floor(n / 8), F.lit(8)).cast("string").alias("length"),
            F.floor(4 * digits / n).cast("string").alias("digits"),
            F.least(F.floor(variety / 3), F.lit(6)).cast("string").alias("variety_of"),
            _vote(private, 1, _vote(public, -1)).cast("string").alias("context"), before.alias("before"))
    return F.transform(spans, of)


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """(row, base, added): the carried columns, checked base spans and labelled candidates."""
    rows = docs.select(F.struct(*(docs[c] for c in carry)).alias("row"),
                       F.coalesce(docs["text"], F.lit("")).alias("text"))
    text = F.col("text")
    for kind in KINDS:
        rows = rows.withColumn(f"{kind}_spans", F.filter(matches(text, kind), passes(kind)))
    base = F.array_sort(F.concat(*[F.col(f"{k}_spans") for k in BASE_KINDS]))
    rows = rows.withColumn("base", base)
    taken, kept = F.col("base"), []
    for kind in ADDED_KINDS:
        own = _apart(F.col(f"{kind}_spans"), taken)
        rows = rows.withColumn(f"{kind}_spans", F.when(F.size(f"{kind}_spans") > 0, own).otherwise(
            F.array().cast(SPAN)))
        kept.append(F.col(f"{kind}_spans"))
        taken = F.concat(taken, F.col(f"{kind}_spans"))
    return rows.select("row", "base", labelled(text, F.array_sort(F.concat(*kept))).alias("added"))


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """Probability of each vote pattern and reliability of each labeler, by expectation-maximisation.

    The first guess grows with the votes' sum, even between one and two; labelers are independent given the truth.
    """
    truth = {p: 1 / (1 + math.exp(1.5 - sum(p))) for p in patterns}
    total, rates = sum(patterns.values()), []
    for _ in range(EM_ROUNDS):
        prior = sum(n * truth[p] for p, n in patterns.items()) / total
        rates = []
        for k in range(len(LABELERS)):
            rate = {(c, v): SMOOTHING for c in (0, 1) for v in (-1, 0, 1)}
            for p, n in patterns.items():
                rate[1, p[k]] += n * truth[p]
                rate[0, p[k]] += n * (1 - truth[p])
            sums = {c: sum(rate[c, v] for v in (-1, 0, 1)) for c in (0, 1)}
            rates.append({key: x / sums[key[0]] for key, x in rate.items()})
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(r[1, v] / r[0, v]) for r, v in zip(rates, p))
            truth[p] = 1 / (1 + math.exp(-max(min(odds, 50), -50)))
    return truth, rates


def train(found: DataFrame) -> dict[tuple[str, str], float] | None:
    """Log odds by (trait, value) of the span classifier, and of the prior under ('', '')."""
    spans = found.select(F.inline("added")).groupBy(*LABELERS, *TRAITS).agg(F.count("*").alias("n"))
    rows = spans.collect()  # combinations of a few values each, however many spans there are
    if not rows:
        return None
    patterns: dict[tuple[int, ...], int] = defaultdict(int)
    for r in rows:
        patterns[tuple(r[k] for k in LABELERS)] += r["n"]
    truth, _ = estimate(patterns)
    counts: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0.0])
    for r in rows:
        p = truth[tuple(r[k] for k in LABELERS)]
        for key in [("", ""), *((t, r[t]) for t in TRAITS)]:
            counts[key][1] += r["n"] * p
            counts[key][0] += r["n"] * (1 - p)
    sums = counts["", ""]
    values = {t: sum(key[0] == t for key in counts) for t in ("", *TRAITS)}
    rate = {key: [(c + SMOOTHING) / (total + SMOOTHING * values[key[0]]) for c, total in zip(n, sums)]
            for key, n in counts.items()}
    odds = {key: math.log(yes / no) for key, (no, yes) in rate.items()}
    return odds | {("", ""): math.log((sums[1] + SMOOTHING) / (sums[0] + SMOOTHING))}


def probability(span: Column, odds: dict[tuple[str, str], float]) -> Column:
    total = F.lit(odds["", ""])
    for trait in TRAITS:
        pairs = [F.lit(x) for (t, value), w in odds.items() if t == trait for x in (value, w)]
        if pairs:
            total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), span[trait]), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def _found(spark: SparkSession, docs: DataFrame, carry: list[str]) -> DataFrame:
    stages = Stages(spark, "privacy")
    found = stages.write("candidates", candidates(docs, carry))
    odds = train(found)
    if odds is None:
        return found.select("row", "base", F.col("base").alias("spans"))
    sure = F.filter("added", lambda s: probability(s, odds) >= THRESHOLD)
    plain = F.transform(sure, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["value"]))
    return found.select("row", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, end, kind, value), by start and kind."""
    return _found(spark, docs, ["doc_id"]).select("row.doc_id", "base", "spans")


def mask(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind."""
    found = _found(spark, docs, docs.columns)
    text = masked(F.col("row")["text"], F.col("spans"))
    return found.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
              for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by the first's."""
    def join(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        wider = last.withField("end", F.greatest(last["end"], s["end"]))
        return F.when(F.coalesce(last["end"], F.lit(0)) <= s["start"], F.concat(kept, F.array(s))).otherwise(
            F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(wider)))
    first = F.aggregate(spans, F.array().cast(SPAN), join)

    def build(kept: Column) -> Column:
        parts = F.transform(kept, lambda s, i: let(
            F.when(i > 0, kept[i - 1]["end"]).otherwise(0), lambda at: F.concat(
                F.substring(text, at + 1, s["start"] - at), F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        rest = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(parts, ""), F.substring(text, rest + 1, F.length(text)))
    return F.when(F.size(spans) > 0, let(first, build)).otherwise(text)
