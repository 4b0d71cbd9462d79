"""Encoding whole texts with the `tokenizers` library, a cache of words in front of it.

A text is cut at spaces that have no white space beside them. Neither tokenizer used
here lets a token reach over such a place, so the ids of the parts, end to end, are
the ids of the text; parts come again and again and are encoded once. A text with
other spacing (for tokenizers that keep white space) is encoded as it is.

A part that is not known yet is split as the tokenizer's file says and goes to the
library's model word by word, without the library's bookkeeping of places; parts with
letters beyond Latin, and tokenizers whose file has other steps, go to its encode().

Added tokens (such as an end-of-text mark written out in a text) are cut out first, as the
library does: what lies between them is encoded as texts of their own. A file whose added
tokens ask for more than their literal text (stripping, whole words, normalised matching)
has all texts encoded by the library.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import regex

#: Fixed: how the byte-level pre-tokenizer splits texts, and the letters that stand for bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: b for b in VISIBLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


def _steps(path: str) -> tuple[str | None, bool]:
    """The pattern that splits normalised texts, and whether texts are composed and lower-cased; None: other steps."""
    with open(path, encoding="utf-8") as f:
        plan = json.load(f)
    norm, pre = plan["normalizer"], plan["pre_tokenizer"] or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return BYTE_LEVEL, False
    kinds = [(x["type"], x.get("content")) for x in (norm or {}).get("normalizers", ())]
    steps = pre.get("pretokenizers", ())
    if kinds == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
        return steps[0]["pattern"]["Regex"], True
    return None, False


class Parts(dict):
    """The ids of each part, made by `make` when it first comes; what was used lately is kept."""

    def __init__(self, make, room: int):
        super().__init__()
        self.make, self.room, self.old = make, room, {}

    def __missing__(self, part: str) -> bytes | None:
        ids = self.old[part] if part in self.old else self.make(part)
        if len(self) >= self.room:
            self.old = dict(self)
            self.clear()
        self[part] = ids
        return ids


class Encoder:
    ROOM = 300_000
    PIECE = 2 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().items())
        self.literal = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added)
        self.added = {t.content: i for i, t in added}
        #: The longest at a place counts.
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: White space gives no ids: cutting at any space is safe.
        self.loose = not self.tokenizer.encode(" \n ", add_special_tokens=False).ids
        pattern, self.lower = _steps(path)
        self.split = regex.compile(pattern).findall if pattern else None
        self.model = self.tokenizer.model
        self.words = Parts(self._word, self.ROOM // 4)
        self.first = Parts(functools.partial(self._part, ""), self.ROOM)
        self.spaced = self.first if self.loose else Parts(functools.partial(self._part, " "), self.ROOM)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, w: str) -> bytes:
        """A word of the split, by the model alone."""
        tokens = self.model.tokenize(w.encode().decode("latin-1").translate(LETTERS))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _part(self, lead: str, part: str) -> bytes | None:
        """None: white space at an end, where the part's neighbours matter."""
        if not self.loose and not (part and not part[0].isspace() and not part[-1].isspace()):
            return None
        if not part or self.split is None or max(part) > "ɏ":
            return self._ids([lead + part])[0]
        if self.lower:
            part = (part if part.isascii() else unicodedata.normalize("NFC", part)).lower()
        if part.isalpha():
            return self._word(lead + part)
        if part[:-1].isalpha() and part[-1] in ".,;:!?":  # no letter, number or apostrophe: a word of its own
            return (self.spaced if lead else self.first)[part[:-1]] + self.words[part[-1]]
        return b"".join(map(self.words.__getitem__, self.split(lead + part)))

    def _known(self, text: str) -> bytes:
        parts = text.split(" ")
        if self.loose:
            return b"".join(map(self.first.__getitem__, parts))
        try:
            return self.first[parts[0]] + b"".join(map(self.spaced.__getitem__, parts[1:]))
        except TypeError:  # a part with white space at an end
            return self._ids([text])[0]

    def _long(self, text: str) -> bytes:
        """Piece by piece, so that a huge text never becomes one list of words."""
        if not self.loose and (text[0].isspace() or text[-1].isspace()):
            return self._ids([text])[0]
        out, at = [], 0
        while at < len(text):
            end = at + self.PIECE
            while (end := text.find(" ", end)) != -1 and not self.loose and (text[end - 1].isspace() or text[end + 1].isspace()):
                end += 1
            end = len(text) if end == -1 else end
            piece = text[at:end]
            if at and not self.loose:  # piece starts with its space
                ids = [self.spaced[p] for p in piece.split(" ")[1:]]
                out.append(self._ids([piece])[0] if None in ids else b"".join(ids))
            else:
                out.append(self._known(piece))
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes of `dtype`; "" has none."""
        for text in texts:
            if not self.literal:
                yield self._ids([text])[0]
            elif any(c in text for c in self.added):
                between = self.marks.split(text)  # texts and marks in turn
                yield b"".join(array(self.code, [self.added[x]]).tobytes() if k % 2 else self._text(x) for k, x in enumerate(between))
            else:
                yield self._text(text)

    def _text(self, text: str) -> bytes:
        return b"" if not text else self._known(text) if len(text) <= 2 * self.PIECE else self._long(text)


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def crc(ids: bytes, dtype: np.dtype) -> int:
    import zlib

    return zlib.crc32(np.frombuffer(ids, dtype).astype("<u4").tobytes())
