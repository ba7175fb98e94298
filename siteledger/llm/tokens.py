"""Byte-level BPE with the tokenizers library, memoised by the unit between two single spaces.

A byte-level pre-tokeniser attaches one space to what follows it. A space between two characters that are not
white space is therefore always a boundary, so a text's ids are those of its units one after another, and each
distinct unit has to pass through the library's model once. Texts with adjacent white space are cut only at such
safe spaces; texts holding an added token's string go through the library whole.
"""

from __future__ import annotations

import re
from array import array

_ADJACENT = re.compile(r"\s\s")
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Units of these characters only are cut into pieces here; others go through the library's own pre-tokeniser.
_PLAIN = re.compile(r"[\n\x21-\x7eÀ-ÖØ-öø-ſ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ſ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ſ]+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others as letters from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class _Memo(dict):
    """Holds at most two generations of ``entries``: what the last one had is taken over when it is asked for."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Text to little-endian ids (2 bytes each if the vocabulary allows it, else 4)."""

    def __init__(self, path: str, entries: int = 350_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.letters = _byte_letters()
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # With and without a space before them.
        self.units, self.heads = _Memo(lambda u: self._unit(" " + u), entries), _Memo(self._unit, entries // 4)

    def _unit(self, unit: str) -> bytes:
        """A unit of one piece goes to the library's model; a longer one is made of the memos' pieces."""
        if len(unit) > 200 or not _PLAIN.fullmatch(unit, 1 if unit[:1] == " " else 0):
            return array(self.code, self.tok.encode(unit, add_special_tokens=False).ids).tobytes()
        pieces = _PIECE.findall(unit)
        if len(pieces) != 1:
            return b"".join([self.units[p[1:]] if p[0] == " " else self.heads[p] for p in pieces])
        shown = unit.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = _SAFE_SPACE.split(text) if _ADJACENT.search(text) else text.split(" ")
        return self.heads[first] + b"".join(map(self.units.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, entries: int = 350_000) -> Encoder:
    """One encoder for each Python worker, so that its memo lasts over the worker's tasks. ``entries`` bounds the memo
    (some 200 bytes an entry, two generations); it changes speed and memory, never ids."""
    key = f"{entries}:{path}"
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, entries)
    return _ENCODERS[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
