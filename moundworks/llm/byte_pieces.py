"""Encoding with a byte-level BPE file of the tokenizers library, every distinct piece once.

The pre-tokeniser of such a file cuts a text into pieces that the merges never cross. Natural text
repeats its pieces, so a worker keeps the ids of those it has met. Texts with characters outside
``PLAIN`` go through the library as a whole; both ways give the same ids. So do texts with the string
of an added token, if ``added_tokens`` says that it stands for the token, as by the library's default;
otherwise it is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

from moundworks.llm.common import worker_cache

#: Letters, marks and separators whose class is the same in every Unicode version.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſЀ-ҁҊ-ԯ"
PLAIN = re.compile(f"[\\t\\n\\r\\x20-\\x7e{LETTERS}‐-‧‰-⁞€]*")
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")
#: A white-space run after a visible character always begins a piece.
SEAM = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])")
SLICE_CHARS = 1 << 20
#: Pieces and words of a generation, and characters of the longest that is kept.
CACHED_PIECES, CACHED_WORDS, CACHED_CHARS = 200_000, 400_000, 64
#: White space followed by a space, of the white space in ``PLAIN``.
SPACE_RUNS = ("  ", "\n ", "\t ", "\r ")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts of about ``size`` characters, cut only where a piece begins anyway."""
    at = 0
    while len(text) - at > size:
        seam = SEAM.search(text, at + size)
        if seam is None:
            break
        yield text[at:seam.start()]
        at = seam.start()
    yield text[at:]


class PieceEncoder(dict):
    """Ids of a piece as little-endian bytes, by piece, in two generations; fills itself.

    New pieces are merged by rank where that is the same as the file's merges. It is if ids number the
    merges in their order and each token comes out of its own bytes: two neighbours that join to a
    token were then made by lower merges inside it alone, as in its own.
    """

    most, longest = CACHED_PIECES, CACHED_CHARS
    #: What ``by_rank`` takes as one piece: all of what it is given.
    taken = r"[\s\S]+"

    def __init__(self, path: str, added_tokens: bool = False):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.table = dict(enumerate(byte_letters()))
        self.old: dict[str, bytes] = {}
        byte_of = {letter: b for b, letter in self.table.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lossless = self.tokenizer.normalizer is None and vocabulary.keys() >= byte_of.keys()
        self.token_bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(byte_of.get(c, 0) for c in token)
        self.by_rank = None
        if self.lossless and merges_in_order(self.tokenizer, vocabulary) and all(
                [t.id for t in self.model.tokenize(token)] == [i] for token, i in vocabulary.items()):
            ranks = {self.token_bytes[i]: i for i in vocabulary.values()}
            self.by_rank = tiktoken.Encoding("pieces", pat_str=self.taken, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of_worker(cls, path: str, added_tokens: bool = False) -> PieceEncoder:
        cache = worker_cache("byte_pieces")
        key = f"{added_tokens}:{path}"
        if key not in cache:
            cache[key] = cls(path, added_tokens)
        return cache[key]

    def ids(self, piece: str) -> bytes:
        """Ids of one piece, worked out."""
        if self.by_rank is not None:
            return array(self.code, self.by_rank.encode_ordinary(piece)).tobytes()
        letters = piece.encode().decode("latin-1").translate(self.table)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.ids(piece)
        if len(piece) <= self.longest:
            self[piece] = ids
        return ids

    def plain(self, part: str) -> bytes:
        """Ids of a text in ``PLAIN`` characters."""
        return b"".join(map(self.__getitem__, PIECES.findall(part)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, ``code`` wide."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        parts = []
        for part in slices(text):
            if PLAIN.fullmatch(part) and not any(token in part for token in self.added):
                parts.append(self.plain(part))
            else:
                ids = self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids
                parts.append(array(self.code, ids).tobytes())
        return b"".join(parts)


class Words(dict):
    """Ids of a space and the characters up to the next one, by those characters; fills itself."""

    def __init__(self, encoder: PieceEncoder):
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():  # one piece
                ids = self.encoder.ids(f" {word}")
            else:
                first, *others = PIECES.findall(f" {word}")
                ids = self[first[1:]] if others and first[1:] else self.encoder.ids(first)
                ids += b"".join(map(self.encoder.__getitem__, others))
                if len(others) > 1:  # seldom met again
                    return ids
        if len(word) < self.encoder.longest:
            self[word] = ids
        return ids


class WordEncoder(PieceEncoder):
    """The same ids, looked up by what stands between spaces: a space after a visible character
    begins a piece, so only texts with a space behind white space are searched for pieces."""

    most = CACHED_WORDS

    def __init__(self, path: str, added_tokens: bool = False):
        super().__init__(path, added_tokens)
        self.words = Words(self)

    def plain(self, part: str) -> bytes:
        if any(run in part for run in SPACE_RUNS):
            return super().plain(part)
        if len(self.words) > self.most:
            self.words.old = dict(self.words)
            self.words.clear()
        first, *others = part.split(" ")
        return super().plain(first) + b"".join(map(self.words.__getitem__, others))


def merges_in_order(tokenizer, vocabulary: dict[str, int]) -> bool:
    """Whether later merges of a file make tokens of higher ids."""
    merges = json.loads(tokenizer.to_str())["model"].get("merges", [])
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in merges]
    return all(a < b for a, b in zip(made, made[1:]))
