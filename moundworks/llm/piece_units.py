"""Encoding with a sentencepiece model, every distinct part of a text once.

A merge joins neighbours only if the result is a piece, so nothing reaches across two characters that
stand side by side in no piece: such a place is a safe boundary, and the parts beside it are encoded by
themselves. In a model whose white space only begins pieces, a space after another character is one,
and so is a line break that no piece holds. Parts are strings of the text as the library sees it:
with the space it puts in front, and U+2581 as the space it stands for.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

from moundworks.llm.common import worker_cache

SPACE = "▁"
UNIT = re.compile(r" +[^ \n]*|\n+|[^ \n]+")
SEAM = re.compile(r"(?<=[^ ])(?= )")
CACHED_UNITS, CACHED_CHARS = 120_000, 64


class PieceUnits:
    """Values (by default the ids as little-endian bytes) of the units of a text.

    ``splits`` tells whether the model keeps texts as they are and has the safe boundaries above;
    otherwise a text is one unit. Values are kept in two generations, so common units stay.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object] | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        Piece = model_pb2.ModelProto.SentencePiece
        written = [p.piece.replace(SPACE, " ") for p in proto.pieces
                   if p.type in (Piece.NORMAL, Piece.USER_DEFINED, Piece.UNUSED)]
        self.pairs = {p[i:i + 2] for p in written for i in range(len(p) - 1)}
        n, t = proto.normalizer_spec, proto.trainer_spec
        self.splits = (
            t.model_type == t.BPE and t.byte_fallback and not t.treat_whitespace_as_suffix
            and not n.precompiled_charsmap and n.add_dummy_prefix and n.escape_whitespaces
            and not n.remove_extra_whitespaces and not any("\n" in p for p in written)
            and not any(SEAM.search(p) for p in written))
        self.token_bytes = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == Piece.BYTE else p.piece.replace(SPACE, " ").encode()
            for p in proto.pieces]
        self.code = "H" if len(proto.pieces) <= 1 << 16 else "I"
        self.value = value or (lambda ids: array(self.code, ids).tobytes())
        self.fresh: dict[str, object] = {}
        self.old: dict[str, object] = {}

    @classmethod
    def of_worker(cls, operator: str, path: str, value=None) -> PieceUnits:
        cache = worker_cache(operator)
        if path not in cache:
            cache[path] = cls(path, value)
        return cache[path]

    def parts(self, text: str, size: int) -> Iterator[str]:
        """The text with its front space in parts of ``size`` characters or little more, cut at safe
        boundaries; a run without any stays whole."""
        if not text:
            return
        text = " " + text.replace(SPACE, " ") if self.splits else text
        at = 0
        while self.splits and len(text) - at > size:
            seam = SEAM.search(text, at + size, at + 2 * size)
            cut = seam.start() if seam else next(
                (i for i in range(at + size, len(text)) if text[i - 1:i + 1] not in self.pairs), len(text))
            if cut == len(text):
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _encoded(self, units: list[str]) -> list[object]:
        """Values of units by one call of the library, whose front space is the unit's own; units
        without one follow a line break (two ids with that space)."""
        if not self.splits:
            return [self.value(ids) for ids in self.processor.encode(units, num_threads=1)]
        texts = [u[1:] if u[0] == " " else "\n" + u for u in units]
        space = self.processor.piece_to_id(SPACE)
        out = []
        for unit, ids in zip(units, self.processor.encode(texts, num_threads=1)):
            out.append(self.value(([space] if unit == " " else ids) if unit[0] == " " else ids[2:]))
        return out

    def of(self, parts: list[str]) -> list[list[object]]:
        """Values of the units of each part, in order."""
        split = [UNIT.findall(p) if self.splits else [p] * bool(p) for p in parts]
        new = set().union(*split).difference(self.fresh)
        if self.old:
            again = {u: self.old[u] for u in new if u in self.old}
            self.fresh.update(again)
            new = new.difference(again)
        new = list(new)
        self.fresh.update(zip(new, self._encoded(new) if new else ()))
        values = [list(map(self.fresh.__getitem__, units)) for units in split]
        for unit in new:
            if len(unit) > CACHED_CHARS:
                del self.fresh[unit]
        if len(self.fresh) > CACHED_UNITS:
            self.old, self.fresh = self.fresh, {}
        return values
