"""Token counts, threshold centroids and alignment against plain versions, also through their queries."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from moundworks.llm import alignment, byte_pieces, perfect_hash, piece_units, queries, threshold_centroids, token_counts

BPE, WORDS, PIECES = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
COLUMNS = ("doc_id long, text string, lang string, n_tokens long, n_bytes string, uid int, k int, part int, "
           "block int, pairs int, batch string, place int")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{'alpha Übung мир gamma don’t x'.split()[i]}{j}" for i, j in zip(
        rng.integers(0, 6, n), rng.integers(0, 500, n)))


TEXTS = [
    (0, None), (1, ""), (2, " "), (3, "   \n\n  a\n b\t\tc  "), (4, "\nline\n\n"), (5, "two words"),
    (6, "literal ▁ mark▁inside ▁▁ it"), (7, "<s> </s> <unk> <0x0A> <|endoftext|> [PAD]"),
    (8, "你好，世界 🎉🎉 ²½ é \x1c \x85 \x00 nul ﬁn"), (9, "x" * 3_001 + "é" * 301 + "=" * 777 + "\t" * 65),
    (10, prose(1, 4_000)), (11, "ab" * 900 + "0123456789" * 90), (12, prose(2, 50)), (12, prose(2, 50)),
    (12, "another text of the id"), (None, prose(3, 40)), (None, prose(3, 40)), (13, "two words"),
    (14, "\n".join(prose(k, 9) for k in range(60))), (15, "tail spaces    "), (16, "中文" * 500 + "\n" + "文中" * 400),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, "s", 1, 2, 3, 4, 5, "b", 6) for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("path", [PIECES, BPE, WORDS])
@pytest.mark.parametrize("long_bytes, chars", [(1 << 18, 1 << 16), (900, 50), (0, 7)])
def test_token_counts_equal_those_of_whole_texts(spark, docs, monkeypatch, path, long_bytes, chars):
    if path.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = library.encode
    else:
        library = Tokenizer.from_file(path)
        def plain(t):
            return library.encode(t, add_special_tokens=False).ids
    monkeypatch.setattr(token_counts, "PART_CHARS", chars)
    got = token_counts.count_tokens(spark, docs, path, long_bytes).collect()
    want = [(i, len((t or "").encode()), len(plain(t)) if t else 0) for i, t in TEXTS]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(spark, docs.where("false"), path).count() == 0


def test_units_hold_all_ids_and_old_ones_come_back(monkeypatch):
    monkeypatch.setattr(piece_units, "CACHED_UNITS", 20)
    library, units = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_units.PieceUnits(PIECES)
    assert units.splits
    for _ in range(2):
        for _, text in TEXTS:
            for size in (3, 60, 10_000):
                parts = list(units.parts(text or "", size))
                ids = b"".join(v for values in units.of(parts) for v in values)
                assert np.frombuffer(ids, units.code).tolist() == library.encode(text or "")
    assert len(units.fresh) <= 20 + 4_000 and units.old


def plain_clusters(rows, k=8, rounds=10, size=64, scale=1024, seed="3"):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    far = [i for i, v in kept if max(map(abs, v)) >= 1 << 27]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) < 1 << 27]
    start = sorted(kept, key=lambda r: (
        r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            members[j].append(v)
        for j, own in members.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign() if centroids else []
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    total = sum(inertia.values())
    return [(i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, found)] + [(i, None, None, None, total, None) for i in far]


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(i % 5, 1, 64).tolist()) for i in range(300)]
    rows += [(i, [float(i % 3)] * 64) for i in range(300, 340)]  # ties and repeated vectors
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (400, None), (401, []), (402, [0.0] * 63),
             (403, [None] + [1.0] * 63), (404, [float("nan")] + [1.0] * 63), (405, [float("-inf")] + [1.0] * 63),
             (406, [1e30] + [0.0] * 63), (407, [-131_072.0] + [0.0] * 63), (408, [0.0] * 64), (409, [-0.0005] * 64)]
    return rows


@pytest.mark.parametrize("rows", [vector_rows(), vector_rows()[:5], vector_rows()[300:340], vector_rows()[-7:-4]])
def test_clusters_equal_plain_rounds(spark, rows):
    table = spark.createDataFrame([(i, v, 0.5, 3, 1) for i, v in rows],
                                  "vec_id long, embedding array<double>, distance double, cluster int, label int")
    got = threshold_centroids.digest(*threshold_centroids.cluster(spark, table.repartition(3)))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_clusters(rows), key=key)
    assert threshold_centroids.digest(*threshold_centroids.cluster(spark, table.where("false"))).count() == 0


def test_threshold_walk_finds_the_nearest_of_many_centroids():
    rng = np.random.default_rng(2)
    for k, size, top in ((1, 3, 5), (7, 2, 3), (40, 5, 20), (300, 2, 1_000)):
        points, centroids = rng.integers(-top, top, (500, size)), rng.integers(-top, top, (k, size))
        label, best = threshold_centroids.nearest(points, centroids)
        all_of = ((points[:, None] - centroids[None]) ** 2).sum(2)
        assert (best == all_of.min(1)).all() and (label == all_of.argmin(1)).all()


def test_perfect_hash_gives_each_key_its_own_slot():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1_000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 62, n))
        hashed = perfect_hash.PerfectHash(perfect_hash.build(keys))
        assert hashed.size == len(keys) and sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
        table = np.zeros(len(keys), np.int64)
        table[hashed.slots(keys)] = keys
        other = np.setdiff1d(rng.integers(0, 1 << 62, 100), keys)
        slot = hashed.slots(other)
        assert len(keys) == 0 or not (table[np.maximum(slot, 0)] == other).any()


class PlainAlignment:
    def __init__(self):
        self.a = Tokenizer.from_file(BPE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        letters = alignment.byte_letters()
        self.byte = {c: bytes([i]) for i, c in enumerate(letters)}

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_raw = [b"".join(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        b_raw = []
        for i in b:
            piece = self.b.id_to_piece(i)
            b_raw.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            return []
        ends = [np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw)]
        common = sorted(set(ends[0]) & set(ends[1]))
        number = {e: g for g, e in enumerate(common)}
        out = [([], []) for _ in common]
        for side, (ids, end) in enumerate(zip((a, b), ends)):
            g = 0
            for i, e in zip(ids, end):
                out[g][side].append(i)
                g += e in number
        return out

    def rows(self, docs):
        held, aligned = Counter(), []
        for _, text in docs:
            groups = self.groups(text)
            links = Counter((x, y) for a, b in groups for x in a for y in b)
            held.update(links.keys())
            aligned.append((groups, links))
        best = defaultdict(int)
        for (x, _), n in held.items():
            best[x] = max(best[x], n)
        for (i, _), (groups, links) in zip(docs, aligned):
            written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
            yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups),
                   sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
                   sum(n * held[p] for p, n in links.items()),
                   hashlib.sha256(written.encode()).hexdigest() if groups else "", written, held)


@pytest.mark.parametrize("batch_bytes, blocks, fan_in, chars, tokens, small", [
    (8 << 20, 256, 512, 1 << 19, 1 << 19, 256), (700, 5, 2, 100, 300, 3), (1, 1, 2, 40, 50, 0)])
def test_alignment_equals_plain_version(spark, docs, monkeypatch, batch_bytes, blocks, fan_in, chars, tokens, small):
    for name, value in (("PART_CHARS", chars), ("ROUND_TOKENS", tokens), ("SMALL_GROUP", small)):
        monkeypatch.setattr(alignment, name, value)
    if batch_bytes < 1_000:
        monkeypatch.setattr(alignment, "by_size", lambda batches, most: (
            b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    table = alignment.PairTable(spark, docs, BPE, PIECES, batch_bytes, blocks, fan_in)
    plain = list(PlainAlignment().rows(TEXTS))
    assert sorted(map(tuple, table.aligned(True).collect()), key=key) == sorted((r[:-1] for r in plain), key=key)
    assert {(r[0], r[1]): r[2] for r in table.pair_counts().collect()} == dict(plain[0][-1])


def test_alignment_of_nothing(spark, docs):
    table = alignment.PairTable(spark, docs.where("false"), BPE, PIECES)
    assert table.aligned().count() == 0 and table.pair_counts().count() == 0
    rows = alignment.PairTable(spark, docs.where("text is null or text = ''"), BPE, PIECES).aligned().collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, 0, 0, "")]


def test_registered_queries_return_the_contract(spark, docs, tmp_path):
    """op11 to op13 through their registered functions over small parquet tables."""
    ids = [(k, t) for k, (_, t) in enumerate(TEXTS)]
    spark.createDataFrame(ids, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(k, v) for k, (_, v) in enumerate(vector_rows())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    named = queries.queries()
    counted = named["op11_token_counts"](spark, str(tmp_path))
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in ids]
    assert sorted(map(tuple, counted.collect())) == want and any(r[3] for r in want)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    clusters = named["op12_threshold_centroids"](spark, str(tmp_path))
    assert sorted(map(tuple, clusters.collect()), key=key) == sorted(plain_clusters(floats), key=key)
    aligned = named["op13_alignment"](spark, str(tmp_path))
    assert aligned.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, aligned.collect())) == [r[:8] for r in PlainAlignment().rows(ids)]


def test_words_give_the_ids_of_the_library(monkeypatch):
    """Fails where words forget all at once or are searched for pieces one text after the other."""
    monkeypatch.setattr(byte_pieces.WordEncoder, "most", 40)
    path = P.path("byte_bpe_50k.json")
    encoder, library = byte_pieces.WordEncoder(path, True), Tokenizer.from_file(path)
    parts = ["ab", "The", " ", "  ", " ", "\n", "\t", "\r", "'s", "'", ".", "12", "é", "Ж", "‐", "中", "<|endoftext|>", "\xa0", "word"]
    rng = np.random.default_rng(5)
    for n in rng.integers(0, 14, 2_000):
        text = "".join(rng.choice(parts, n))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), f"<u{np.dtype(encoder.code).itemsize}").tolist() == ids, text
    assert encoder.words.old and len(encoder.words) <= 40 + 14
    assert encoder.by_rank is not None
