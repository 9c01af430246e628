"""Cases in which an operator once did less than the whole job, against plain versions."""

import types
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from moundworks.llm import block_search, cross_parsing, metric_join, privacy, queries, repeats

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near_copies(rows):
    """Rows (doc_id, text) that stay: of each group of links the smallest id."""
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    members = {}
    for row, g in zip(rows, group):
        members.setdefault(g, []).append(row)
    return group, [min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()]


def near_rows():
    rng = np.random.default_rng(7)
    rows = []
    for base in range(30):
        words = [f"w{k}" for k in rng.integers(0, 3_000, rng.integers(20, 400))]
        for copy in range(8):
            other = list(words)
            for at in rng.integers(0, len(other), copy // 3):
                other[at] = f"x{rng.integers(0, 9_999)}"
            rows.append((len(rows), " ".join(other)))
    rows += [(5, "one id, another text than the other row of it"), (None, rows[3][1]), (None, "no id and no copy"),
             (None, "no id and  NO copy"), (900, None), (901, " \t "), (902, "two words"), (903, "Two\nwords"),
             (12, rows[12][1]), (3_000, rows[40][1])]
    return rows


def test_near_copies_are_the_groups_of_fingerprints(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows],
                                 "doc_id long, text string, `a.b` int, key int").repartition(5)
    group, want = plain_near_copies(rows)
    assert 1 < max(map(group.count, group)) and len(set(group)) > 30
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    left = [(r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in got.collect()]
    assert sorted(left, key=str) == sorted([(i, " ".join((t or "").lower().split())) for i, t in want], key=str)
    assert corpus_pipeline.near_copies(spark, docs.where("false"), "").count() == 0


def test_run_equals_plain_stages(spark, tmp_path):
    """All rows of run(); the language and the personal data of a text come from the operators, which
    other tests hold against plain versions, the rest from plain ones."""
    rng = np.random.default_rng(4)
    english = "the of and to in is that for it as was with be by on not he his but at are this have from".split()
    german = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an".split()
    shared = "this passage of well over fifty bytes stands in more than one of the documents"
    rows = []
    for k in range(60):
        words = rng.choice((english, german)[k % 2], 80)
        text = " ".join(words) + (f". {shared}" if k % 4 == 0 else "") + (f" write to user{k}@example.org" if k % 5 == 0 else "")
        rows.append((k, text, ("en", "de")[k % 2]))
    rows += [(100 + k, t, lang) for k, (_, t, lang) in enumerate(rows[:6])]
    rows += [(200, None, None), (201, "", "en"), (202, "12 34 !!", None), (203, rows[7][1] + " x", "de"), (204, "qqq zzz", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], schema)
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    read = corpus_pipeline.languages(spark, docs, str(tmp_path)).collect()
    assert {200, 201, 202}.isdisjoint(r["doc_id"] for r in read) and len(read) > 60
    _, kept = plain_near_copies([(r["doc_id"], r["text"]) for r in read])
    assert len(kept) < len(read) - 4
    first, left = {}, {}
    for i, t in sorted(kept):
        raw = t.encode()
        for at in range(len(raw) - 49):
            first.setdefault(raw[at:at + 50], i)
    for i, t in kept:
        raw, gone = t.encode(), set()
        for at in range(len(raw) - 49):
            if first[raw[at:at + 50]] < i:
                gone.update(range(at, at + 50))
        left[i] = bytes(b for at, b in enumerate(raw) if at not in gone).decode()
    assert sum(left[i] != t for i, t in kept) > 5
    clean = privacy.mask(spark, spark.createDataFrame(sorted(left.items()), "doc_id long, text string")).collect()
    assert sum("<EMAIL>" in r["text"] for r in clean) > 5
    want = {r["doc_id"]: library_ids(r["text"]) + [0] for r in clean}
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    got, at = {}, 0
    for r in pieces:
        assert (r["sequence_id"], r["offset"]) == divmod(at, 1024) and r["start"] == len(got.get(r["doc_id"], []))
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
        at += r["length"]
    assert got == want


def test_pivots_of_one_direction_lose_no_links(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=16)
    near = [middle + rng.normal(size=16) * 0.03 for _ in range(200)]
    rows = [(k, v.tolist()) for k, v in enumerate(near)]
    rows += [(1_000 + k, (near[k % 2] * (3.0 + k)).tolist()) for k in range(200)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r for r in metric_join.near_vectors(spark, frame, 0.98, 10, 8_000).collect()}
    assert [got[i]["n_links"] for i, _ in rows] == links.tolist()
    assert links.min() > 0 and {r["component_id"] for r in got.values()} == {0}


def library_ids(text):
    return Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_added_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    texts = ["end <|endoftext|> start", "<|endoftext|><|endoftext|>", "plain words", "é <|endoftext|>\n\n  x", "<|endoftext|",
             "long \n words " * 90_000 + "<|endoftext|> tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: library_ids(t) + [0] for i, t in enumerate(texts)}
    assert 50256 in want[0]
    files = {r["doc_id"]: r for r in queries.op2_token_files(spark, str(tmp_path)).collect()}
    for i, ids in want.items():
        assert (files[i]["n_tokens"], files[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    pieces = {r["doc_id"]: r["doc_tokens"] for r in queries.op9_packing(spark, str(tmp_path)).collect()}
    assert pieces == {i: len(ids) for i, ids in want.items()}
    for r in corpus_pipeline.packed(spark, docs, "").collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"]:r["start"] + r["length"]]


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    other = rng.normal(size=8).tolist()
    frame = spark.createDataFrame(rows + [rows[0]] * 2 + [(20, other)], "vec_id long, embedding array<double>")
    found = block_search.nearest(spark, frame, F.col("vec_id") % 20 == 0).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}

    def plain(query, vector):
        candidates = [(i, unit[i]) for i, _ in rows + [rows[0]] * 2 if i != query]
        candidates += [(20, np.array(other) / np.linalg.norm(other))] * (query != 20)
        vector = np.array(vector) / np.linalg.norm(vector)
        return [i for _, i in sorted((-round(float(vector @ w), 12), i) for i, w in candidates)[:5]]
    for query in (0, 40):
        mine = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert mine == list(enumerate(plain(query, dict(rows)[query]), 1))
    both = sorted(enumerate(plain(20, dict(rows)[20]), 1)) + sorted(enumerate(plain(20, other), 1))
    assert sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 20) == sorted(both)


def test_no_character_of_a_found_span_is_left(spark):
    docs = spark.createDataFrame([(1, "at 10.0.0.18 4111 1111 1111 1111 end"), (2, "a@b.org and 10.0.0.1, x"), (3, None)],
                                 "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in privacy.mask(spark, docs).collect()}
    assert got == {1: "at <IP> end", 2: "<EMAIL> and <IP>, x", 3: None}


def test_rows_of_one_id_are_decided_one_by_one(spark):
    text, other = "one two three four five six seven eight", "nothing like the text of the other rows"
    rows = [(1, text), (2, text + " "), (2, other), (None, text.upper()), (None, "only once"), (None, "only  once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], " ".join(r["text"].split())) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text), (2, other), (None, "only once")], key=str)


def greedy_phrases(kinds, trained):
    """Phrases of a parse from left to right, each the longest that the training text holds."""
    trained, n, at = "".join(map(chr, trained)), 0, 0
    text = "".join(map(chr, kinds))
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in trained:
            size += 1
        at, n = at + size, n + 1
    return n


def test_long_texts_are_one_parse(monkeypatch):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    trained = " ".join(rng.choice(words, 2_000))
    letters = cross_parsing.Letters.seen_in([trained])
    kinds = letters.of([trained])[0]
    table = cross_parsing.automaton_table(cross_parsing.suffix_automaton(kinds.tolist()), letters.count)
    texts = [trained[:8_000], " ".join(rng.choice(words, 1_500)), "".join(rng.choice(list("abcdefgh "), 6_000)),
             trained[5:3_000] + trained[70:2_500] * 2, "", "a", "abc" * 700, trained[:512], trained[:513], trained[100:1_124]]
    for block, meeting in ((512, 64), (7, 3), (50, 1)):
        monkeypatch.setattr(cross_parsing, "BLOCK", block)
        monkeypatch.setattr(cross_parsing, "MEETING", meeting)
        own, doc = letters.of(texts)
        got = cross_parsing.phrase_counts(own, doc, len(texts), table, letters.count)
        want = [greedy_phrases(own[doc == i].tolist(), kinds.tolist()) for i in range(len(texts))]
        assert got.tolist() == want and want[0] == 1 and max(want) > 500


def test_a_task_sends_the_runs_of_a_text_once():
    text = "".join(chr(97 + i * i * 7 % 26) for i in range(300))
    batch = pa.RecordBatch.from_pydict({"same": [1] * 500 + [2], "text": [text] * 500 + [text[::-1]]})
    pack = repeats.run_packer(1, types.SimpleNamespace(value=np.array([], np.int64)))
    sent = [np.frombuffer(b, "<i8") for out in pack(iter([batch, batch])) for b in out.column("same").to_pylist()]
    one = sum(len(c) for _, _, c, _ in repeats.runs_of([text.encode(), text[::-1].encode()]))
    assert sum(map(len, sent)) == one


def test_intervals_are_spread_in_bounded_parts(monkeypatch):
    """All places of 2,000 intervals at once held 16 bytes for each of their members' bytes."""
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 123, 110).astype(np.uint8))
    cuts = [base[:n] + bytes([65 + i]) for i, n in enumerate(range(60, 110))]
    lowest = rng.permutation(len(cuts)).astype(np.int64)
    whole = repeats.smallest_documents(cuts, lowest)
    sizes, spread = [], repeats._expanded
    monkeypatch.setattr(repeats, "PLACES_AT_ONCE", 100)
    monkeypatch.setattr(repeats, "_expanded", lambda c: sizes.append(int(c.sum())) or spread(c))
    parts = repeats.smallest_documents(cuts, lowest)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert max(sizes) <= 100 + repeats.WIDTH
