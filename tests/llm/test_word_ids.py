"""Words that the alignment looks up give the ids of both libraries, new ones by few calls."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from moundworks.llm import alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a ", "a b ", " a", "  ", " ", "a  b", "a\n b", "a\nb c\n", "a b\n\n", "a\t", "\nab c", "x \n", "don't we're 'till '", "a▁b c",
       "zwölf Ärzte, 12,5 € (ein)", "числа и слова", "日本 語 x", "é f", "a" * 200 + " b", "<|endoftext|> a", "Q.E.D. -- !?'s 3rd\r\nx", "…'s"]


@pytest.fixture
def tokenizers():
    return alignment.Tokenizers(BYTE, PIECE)


def joined(parts, kind):
    return [i for part in parts for i in part[kind].tolist()]


def test_ids_are_the_libraries(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 40)  # generations change
    monkeypatch.setattr(alignment, "WORDS_AT_ONCE", 7)
    rng = random.Random(5)
    mixed = ["".join(rng.choice(["a", "the", " ", " ", "\n", "\t", "'", "s", ".", "ß", "9", " word", "—", "‧"]) for _ in range(rng.randrange(1, 60)))
             for _ in range(600)]
    texts = [*ODD, *mixed, *ODD, " ".join(mixed) * 12]
    assert len(texts[-1]) > alignment.PART_CHARS
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    for some in (texts[i:i + 50] for i in range(0, len(texts), 50)):
        for text, parts in zip(some, tokenizers.encode(some)):
            if "▁" in text:
                assert parts == []
                continue
            assert joined(parts, 0) == a.encode(f" {text}", add_special_tokens=False).ids
            assert joined(parts, 1) == b.encode(text)
            assert all(x.dtype == np.int64 for part in parts for x in part)


def test_new_words_are_encoded_by_few_calls(tokenizers):
    calls, rank = [], tokenizers.a.by_rank

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return rank.encode_ordinary(text)

    tokenizers.a.by_rank = Counted()
    tokenizers.encode([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))])
    assert 1 <= len(calls) <= 3
