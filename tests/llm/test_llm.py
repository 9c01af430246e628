"""Each operator against a plain version, on rows with nulls, copies, long texts and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from moundworks.llm import (
    block_search, byte_bpe, cross_parsing, metric_join, packing, privacy, repeats, simhash,
    token_file, toxicity)
from moundworks.llm.common import by_size

BPE, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SHARED = "This passage of more than fifty bytes stands in several of the documents, word for word. "
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 99, n)))


ROWS = [
    (0, prose(0, 80) + ". " + SHARED + prose(1, 40)), (1, None), (2, ""), (3, "   \n\t "), (4, "two words"),
    (5, prose(2, 60) + "\n" + SHARED + prose(3, 30)), (6, prose(0, 80) + ". " + SHARED + prose(1, 40)),
    (7, "Écoute ça : “naïf” — 你好, мир! \x1c   ﬁn 🎉🎉 ²½ don't <|endoftext|>"),
    (8, prose(4, 4_000)), (9, "x" * 3_000 + " " + "é" * 300), (10, "ab" * 200 + "\n" + "ab" * 100),
    (11, "Mail a.b+c@mail.example.org@x.y from 10.0.0.255 or 1.2.3.256, call +1 (555) 010-9999 now; card "
         "4111 1111-1111 1111 and 4111111111111112, token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" " + prose(6, 90)),
    (12, prose(0, 80) + ". " + SHARED + prose(1, 39) + " other"), (12, prose(5, 20)), (4, "two words"),
    (None, prose(0, 80) + ". " + SHARED), (None, None), (13, "nul \x00 byte " * 30), (14, "nul \x00 byte " * 29),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is not None and i % 2 else "xx", None, 7, "s", 1.5, b"z") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, value int, "
                                       "spans string, score double, ids binary").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def ids_of(text):
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_hold_all_ids_in_order(spark, docs, nothing):
    rows = token_file.token_files(spark, docs, BPE).collect()
    want = sorted(((i is not None, i or 0, t is not None, t or ""), i, ids_of(t)) for i, t in ROWS)
    start, plain = 0, []
    for _, i, ids in want:
        plain.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == plain
    assert token_file.token_files(spark, nothing, BPE).count() == 0


def test_batches_by_size_keep_every_row():
    texts = [None, "", "é" * 5, "a" * 40, None, "b", "c" * 9, ""]
    batch = pa.RecordBatch.from_pydict({"n": range(len(texts)), "text": pa.array(texts, pa.string())})
    parts = list(by_size(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), 10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts + texts[2:5]
    assert all(p.num_rows for p in parts) and len(parts) > 4


def test_packing_cuts_one_stream(spark, docs, nothing):
    rows = packing.pack(spark, docs, BPE, window=64, keep_ids=True).collect()
    at = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in rows)
    assert [a for a, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1].tolist()]
    assert all(r["offset"] + r["length"] <= 64 and crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
               for r in rows)
    assert sum(r["length"] for r in rows) == sum(len(ids_of(t)) for _, t in ROWS)
    one = sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["start"])
    assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in one]).tolist() == ids_of(dict(ROWS)[8])
    assert packing.pack(spark, nothing, BPE).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (300, 40), (50, 10)])
def test_byte_bpe_equals_whole_encoding(spark, docs, nothing, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(spark, docs, RANKS, P.PATTERN, chunk, overlap)
    want = []
    for i, t in ROWS:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, byte_bpe.digest(encoded, RANKS).collect()))) == sorted(map(str, want))
    assert byte_bpe.digest(byte_bpe.encode(spark, nothing, RANKS, P.PATTERN), RANKS).count() == 0


def test_stitching_goes_on_behind_a_long_run(spark):
    text = prose(1, 400) + " " + "x" * 2_000 + "\n" + prose(2, 30) + "!\n?" + " -" * 300 + "\n\n" + prose(3, 400)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cut = docs.mapInArrow(byte_bpe.chunk_cutter(300, 40), byte_bpe.CHUNKS)
    pieces = [r["text"] for r in byte_bpe.stitched(cut, P.PATTERN, 300, 40).orderBy("piece").collect()]
    assert "".join(pieces) == text and len(pieces) > 20
    assert sorted(map(len, pieces))[-2] < 1_000 and max(map(len, pieces)) < 3_000
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for chunk, overlap in [(300, 40), (37, 9)]:
        ids = byte_bpe.encode(spark, docs, RANKS, P.PATTERN, chunk, overlap).first()["ids"]
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    rows = simhash.near_copies(spark, docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in ROWS]
    group = {f: f for _, f in prints}
    for _ in prints:
        for f in group:
            for g in group:
                if (f ^ g).bit_count() <= 3:
                    group[f] = group[g] = min(group[f], group[g])
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[group[f]] = min(smallest.get(group[f], i), i)
    want = [(i, f, smallest.get(group[f])) for i, f in prints]
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_copies(spark, nothing).count() == 0


def test_every_link_of_three_bits_comes_out_once(spark):
    rng = np.random.default_rng(1)
    values = {0}
    for base in rng.integers(0, 1 << 62, 30).tolist():
        values.add(base)
        for _ in range(12):
            value = base
            for b in rng.integers(0, 63, rng.integers(1, 5)).tolist():
                value ^= 1 << b
            values.add(value)
    values = sorted(values)
    table = spark.createDataFrame(list(enumerate(values)), "rep long, fingerprint long")
    got = [tuple(sorted(r)) for r in simhash.links(table).collect()]
    want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if (values[i] ^ values[j]).bit_count() <= 3]
    assert sorted(got) == want


def test_repeats_remove_what_a_smaller_document_has(spark, docs, nothing, monkeypatch):
    seen, removed = {}, []
    order = sorted(ROWS, key=lambda r: repeats.LAST if r[0] is None else r[0])
    for i, t in order:
        data, rank = (t or "").encode(), repeats.LAST if i is None else i
        for a in range(len(data) - 49):
            seen.setdefault(data[a:a + 50], rank)
    for i, t in order:
        data, rank = (t or "").encode(), repeats.LAST if i is None else i
        gone = np.zeros(len(data) + 1, int)
        for a in range(len(data) - 49):
            if seen[data[a:a + 50]] < rank:
                gone[a:a + 50] = 1
        kept = np.frombuffer(data, np.uint8)[gone[:-1] == 0].tobytes()
        removed.append((i, len(data), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()),
                        hashlib.sha256(kept).hexdigest()))
    for cuts in (25_000, 2):  # the second deals every key out
        monkeypatch.setattr(repeats, "ARRAY_CUTS", cuts)
        got = repeats.digest(repeats.repeated_spans(spark, docs)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, removed))
    assert repeats.digest(repeats.repeated_spans(spark, nothing)).count() == 0


def test_suffix_array_puts_out_maximal_repeats():
    cuts = [b"q" + b"a" * 30 + b"b" * 30, b"r" + b"a" * 30 + b"b" * 30, b"a" * 30 + b"b" * 25 + b"zz"]
    array = repeats.SuffixArray(cuts)
    found = {(n, frozenset(array.cut[a:b + 1].tolist())) for n, a, b in array.maximal_repeats()}
    assert found == {(60, frozenset({0, 1})), (55, frozenset({0, 1, 2}))}


def plain_spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    found = []
    for k, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(p) < 256 for p in m.group().split(".")) if kind == "ip" else 0,
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_privacy_keeps_base_spans_and_adds_secrets(spark, docs, nothing):
    many = "; ".join(f"u{k}@h{k}.org 10.0.{k % 256}.{k % 300}" for k in range(700))
    docs = docs.unionByName(docs.where("doc_id = 2").withColumn("text", F.lit(many)))
    rows = privacy.summary(privacy.find(spark, docs)).collect()
    want = sorted(str((i, hashlib.sha256(plain_spans(t).encode()).hexdigest())) for i, t in [*ROWS, (2, many)])
    assert sorted(str((r["doc_id"], r["base_sha256"])) for r in rows) == want
    masked = {r["doc_id"]: r["text"] for r in privacy.mask(spark, docs).where("doc_id in (5, 11)").collect()}
    assert masked[5] == dict(ROWS)[5]
    assert "<EMAIL>" in masked[11] and "<IP>" in masked[11] and 'token = "<SECRET>"' in masked[11]
    assert "1.2.3.256" in masked[11] and "<CARD>" in masked[11] and "<PHONE>" in masked[11]
    assert privacy.summary(privacy.find(spark, nothing)).count() == 0


def test_toxicity_learns_insults(spark, docs, nothing):
    rows = [(100 + k, prose(k, 30) + (f" you idio{k % 5}. what a clown" if k % 4 == 0 else ".")) for k in range(400)]
    more = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = more.selectExpr("doc_id", "int(doc_id % 4 = 0) toxic", "0 quality")
    all_docs = more.unionByName(docs.select("doc_id", "text"))
    scored = toxicity.score(spark, all_docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert len(scored) == 400 + len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in scored if (r["doc_id"] or 0) >= 100)
    assert not any(r["predicted"] for r in scored if (r["doc_id"] or 0) < 100)
    assert toxicity.score(spark, nothing, labels.where("false"), F.lit(True)).count() == 0
    grammar = toxicity.Grammar({"idiot": 3.0})
    assert grammar.clause("you idiot") > grammar.clause("an idiot") > grammar.clause("not an idiot") > 0
    assert grammar.clause("they said an idiot") < grammar.clause("they are an idiot")
    assert grammar.clause("an idiot they said") == grammar.clause("they said an idiot")
    assert grammar.clause("an idiot he is not") < grammar.clause("an idiot he is")
    assert grammar.clause("kill") == 0 < grammar.clause("kill you")
    assert grammar.clause("idiot") == grammar.clause("idiot, not idiot") == 0


def test_single_words_between_marks_join_a_clause():
    assert toxicity.clauses("idiot! you did it. go!! on!! ...\n now") == ["idiot  you did it", " go  on    now"]
    assert toxicity.clauses("idiot!") == ["idiot "] and toxicity.clauses(" .. !") == toxicity.clauses("") == []
    grammar = toxicity.Grammar({"idiot": 3.0})
    assert grammar.features("The. House. Idiot!")[0] > 0 == grammar.features("Idiot!")[0]


def plain_clause(words):
    """One accepted path per insult or threat of the clause."""
    kinds, total = [kind for kind, _ in words], 0.0
    for at, (head, value) in enumerate(words):
        around = kinds[:at] + kinds[at + 1:]
        if head == "insult":
            about = 1.25 if "target" in around else 1.0 if {"other", "threat"} & set(around) else 0.0
        else:
            about = float("target" in around) if head == "threat" else 0.0
        near = kinds[max(at - 4, 0):at] + kinds[at + 1:at + 5]
        total += value * about * (0.4 if "negation" in near else 1.0) * (0.6 if "report" in around else 1.0)
    return total


def test_clause_weights_sum_all_accepted_paths():
    rng = np.random.default_rng(8)
    grammar = toxicity.Grammar({"idiot": 3.0, "clow": 1.7})
    words = "idiot clowns kill you not said the house burn them".split()
    for n in [*range(8)] * 150:
        clause = rng.choice(words, n).tolist()
        assert grammar.clause(" ".join(clause)) == pytest.approx(plain_clause([grammar.classify(w) for w in clause]))


def test_languages_by_fewest_phrases(spark, nothing):
    rng = np.random.default_rng(3)
    parts = {"aa": "tion the and ing of her".split(), "bb": "sch ung ein der keit ich".split()}
    rows = [(k, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(60)), lang)
            for k, lang in enumerate(["aa", "bb"] * 40)]
    rows += [(200, None, "aa"), (201, "123 !!", "bb"), (202, "", None), (None, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in cross_parsing.identify(spark, docs, F.col("doc_id") % 3 != 1).collect()}
    assert all(found[k]["lang_pred"] == lang for k, _, lang in rows[:80])
    assert [found[k]["lang_pred"] for k in (200, 201, 202, None)] == ["und", "und", "und", "aa"]
    assert found[200]["score"] == 0 and found[0]["score"] > 0.9
    assert cross_parsing.identify(spark, nothing, F.lit(True)).count() == 0


def test_phrase_counts_equal_greedy_parsing():
    rng = np.random.default_rng(4)
    train, text = rng.integers(1, 4, 60).tolist(), rng.integers(1, 5, 400)
    table = cross_parsing.automaton_table(cross_parsing.suffix_automaton(train), 6)
    known, phrases, current = "".join(map(str, train)), 1, ""
    for c in map(str, text):
        if current + c in known:
            current += c
        else:
            phrases += 1 + (c not in known)
            current = c if c in known else ""
    got = cross_parsing.phrase_counts(text.astype(np.uint8), np.zeros(400, int), 1, table, 6)
    assert got[0] == phrases


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(k, (base[k % 40] + rng.normal(size=8) * 0.04 * (k // 40)).tolist(), k % 3 if k < 150 else 1)
            for k in range(160)]
    rows += [(160, rows[0][1], 0), (161, rows[0][1], 0), (162, rows[0][1], None), (163, [0.0] * 8, 1),
             (164, None, 1), (165, [float("nan")] + [1.0] * 7, 1), (166, [float("inf")] * 8, 1),
             (167, [1.0, 2.0], 1), (168, [], 1), (169, [None] + [1.0] * 7, 1), (None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return rows, frame.withColumn("point", F.lit("x")).withColumn("cell", F.lit(1))


def _usable(v):
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


@pytest.mark.parametrize("cell, block", [(2_000, 8_000), (7, 5)])
def test_metric_join_finds_all_links(spark, vectors, cell, block):
    rows, frame = vectors
    links = {}
    for i, v, a in rows:
        links[i] = [j for j, w, b in rows if i is not None and j is not None and i != j and a is not None
                    and a == b and _usable(v) and _usable(w) and len(v) == len(w)
                    and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
    low = {i: i for i in links}
    for _ in rows:
        for i in links:
            for j in links[i]:
                low[i] = low[j] = min(low[i], low[j])
    got = metric_join.near_vectors(spark, frame, 0.98, cell, block).collect()
    assert len(got) == len(rows) and sum(map(len, links.values())) > 50
    for r in got:
        assert (r["n_links"], r["component_id"]) == (len(links[r["vec_id"]]), low[r["vec_id"]])
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert metric_join.near_vectors(spark, frame.where("false")).count() == 0


def test_block_search_equals_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(block_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(block_search, "CANDIDATE_BLOCK", 11)
    rows, frame = vectors
    got = {}
    for r in block_search.nearest(spark, frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    usable = [(i, np.array(v)) for i, v, _ in rows if i is not None and _usable(v)]
    for q, v in usable:
        if q % 20 == 0:
            best = sorted((-float(np.round(v @ w / np.linalg.norm(v) / np.linalg.norm(w), 12)), i)
                          for i, w in usable if i != q and len(w) == len(v))[:5]
            assert [i for i, _ in got[q]] == [i for _, i in best]
            assert np.allclose([s for _, s in got[q]], [-s for s, _ in best], atol=1e-12)
    assert set(got) == {q for q, _ in usable if q % 20 == 0}
    assert block_search.nearest(spark, frame.where("false"), F.lit(True)).count() == 0


def test_first_pass_wants_every_neighbour_and_few_others():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(3_000, 64))
    base[1_000:2_000] = base[0] + rng.normal(size=(1_000, 64)) * 1e-3
    ids = np.arange(3_000)
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    exact = unit @ unit.T
    np.fill_diagonal(exact, -np.inf)
    asked = np.array([2_100, 2_200, 2_300])
    queries = block_search.Block.of_vectors(asked, base[asked])
    best, wanted = np.full((3, 5), -np.inf, np.float32), []
    for a in range(0, 3_000, 700):
        candidates = block_search.Block.of_vectors(ids[a:a + 700], base[a:a + 700])
        again = block_search.Block.of_row({**candidates.stored(), "vectors": None})
        lower, upper = block_search.tile_bounds(queries, again, 0)
        held = exact[asked][:, a:a + 700]
        others = held > -1
        assert (lower <= held).all() and (held <= upper).all() and (upper[others] - lower[others] < 0.05).all()
        wanted.append(block_search.wanted_rows(queries, again, best))
    wanted = np.concatenate(wanted)
    assert wanted[np.argsort(-exact[asked], axis=1)[:, :5].ravel()].all() and wanted.sum() < 300


def test_pipeline_stages_take_effect(spark, docs, tmp_path):
    docs = docs.withColumn("n_chars", F.lit(0).cast("long"))
    given = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, given, str(tmp_path)).write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert got.columns == docs.columns
        if name == "near_copies":
            ids = {r["doc_id"] for r in got.collect()}
            assert ids >= {0, 5, 8, 11} and not ids & {1, 2, 3, 6}  # no letters; a copy of 0
        if name == "repeats":
            texts = {r["doc_id"]: r["text"] for r in got.collect()}
            assert SHARED in texts[0] and SHARED not in texts[5]
        if name == "personal_data":
            assert "<EMAIL>" in got.where("doc_id = 11").first()["text"]
        given = got
    assert given.agg(F.sum("length")).first()[0] > 0
