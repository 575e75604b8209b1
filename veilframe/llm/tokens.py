"""Encoding texts with a given tokenizer file, piece by piece with a bounded memory of pieces.

The tokenizer library does all encoding. Where the tokenizer's own rules cut a
text, its parts encode independently, so a part seen before need not be encoded
again. Only cuts that hold for every text are used:

* with a byte-level pre-tokenizer, before a space that follows a non-space;
* where white space is dropped, at every space;
* in both, between a Latin letter and ASCII punctuation or a line end behind it,
  and between a lone line end and a letter behind it.

A part of Latin letters alone is one pre-token, so it goes straight to the
library's model, in the byte alphabet the library itself gives for each letter.

Any other tokenizer, and any text that may hold a special token, is encoded whole.
"""

from __future__ import annotations

import json
import re
from array import array

from veilframe.llm.common import forget, keeps

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_INSIDE = re.compile(rf'(?<=[{_LETTERS}])(?=[\n!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~])|(?<=\S\n)(?=[{_LETTERS}])')
_WORD = re.compile(rf"[{_LETTERS}]+")
_SIMPLE = re.compile(rf'([{_LETTERS}]+)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]*)')
_GLUED = re.compile(r"(?<=\S) ")
_ODD_SPACE = re.compile(r"\s ")
MEMORY = 600_000  # entries of each memory
LONGEST = 64  # characters of a piece worth remembering


def _kind(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    model = spec.get("model") or {}
    if model.get("type") != "BPE" or spec.get("post_processor"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "glued"
    if pre.get("type") == "Sequence" and norm and norm.get("type") == "Sequence":
        known = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norm["normalizers"])
        steps = pre["pretokenizers"]
        split = steps[0]
        drops = split["type"] == "Split" and split.get("invert") and split["behavior"] == "Removed"
        classes = drops and re.sub(r"'\w+\|", "", split["pattern"].get("Regex", "")) == r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        rest = all(s["type"] == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in steps[1:])
        if known and classes and rest:
            return "dropped"
    return "whole"


class _Memory(dict):
    """What was encoded before. A full one takes nothing more for a while, so that
    frequent strings, which come early, are not driven out by ones that never return."""

    def __init__(self, most: int):
        super().__init__()
        self._refused, self._most = 0, most

    def keep(self, key: str, out: bytes) -> bytes:
        if len(self) < self._most:
            if len(key) <= LONGEST:
                self[key] = out
        else:
            self._refused += 1
            if self._refused >= 20 * self._most:
                self._refused = 0
                self.clear()
        return out


class _Parts(_Memory):
    """Token bytes of parts that the tokenizer itself keeps apart."""

    def __init__(self, encode, most: int):
        super().__init__(most)
        self._encode = encode

    def __missing__(self, part: str) -> bytes:
        return self.keep(part, self._encode(part))


class _Pieces(_Memory):
    """Token bytes of pieces between spaces, ``lead`` being what stands before each."""

    def __init__(self, parts: _Parts, lead: str, word, most: int):
        super().__init__(most)
        self._parts, self._lead, self._word = parts, lead, word

    def __missing__(self, piece: str) -> bytes:
        if simple := _SIMPLE.fullmatch(piece):
            word, marks = simple.groups()
            return self.keep(piece, self[word] + self._parts[marks] if marks else self._word(piece))
        whole = self._lead + piece
        return self.keep(piece, b"".join(map(self._parts.__getitem__, _INSIDE.split(whole))) if whole else b"")


class Encoder:
    """``encoder(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = MEMORY):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self._tokenizer.to_str())
        self._kind = _kind(spec)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._model = self._tokenizer.model
        self._lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        single = [c for c in map(chr, range(0x20, 0x100)) if c == " " or _WORD.fullmatch(c)]
        self._bytes = {ord(c): alphabet.pre_tokenize_str(c)[0][0] for c in single}
        self._parts = _Parts(self.part, most)
        self._pieces = _Pieces(self._parts, " " if self._kind == "glued" else "", self._word(), most)

    def _word(self):
        """What encodes a piece of Latin letters alone, with what stands before it."""
        tokenize, letters = self._model.tokenize, self._bytes
        mark = letters[ord(" ")] if self._kind == "glued" else ""
        lowers = self._lowers and self._kind == "dropped"

        def word(piece: str) -> bytes:
            piece = piece.lower() if lowers else piece
            piece = mark + (piece if piece.isascii() else piece.translate(letters))
            return array("I", [t.id for t in tokenize(piece)]).tobytes()

        return word

    def part(self, text: str) -> bytes:
        """Ids of a part that the tokenizer keeps apart from its neighbours."""
        word = text[1:] if self._kind == "glued" and text[:1] == " " else text
        if not _WORD.fullmatch(word):
            return self.whole(text)
        if self._kind == "dropped":
            text = text.lower() if self._lowers else text
        return array("I", [t.id for t in self._model.tokenize(text.translate(self._bytes))]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if self._kind == "whole" or any(s in text for s in self._special):
            return self.whole(text)
        if self._kind == "dropped":
            return b"".join(map(self._pieces.__getitem__, text.split(" ")))
        pieces = _GLUED.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        first = b"".join(map(self._parts.__getitem__, _INSIDE.split(pieces[0]))) if pieces[0] else b""
        return first + b"".join(map(self._pieces.__getitem__, pieces[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = MEMORY) -> Encoder:
    """One encoder per file and Python process; workers are reused, so are its memories of ``most`` entries."""
    forget(__name__)
    key = f"{path}:{most}"
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, most)
    return _ENCODERS[key]


keeps(__name__, _ENCODERS)
