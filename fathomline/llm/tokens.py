"""Byte-level BPE ids of texts by the tokenizers library, with each distinct stretch of text encoded once per process.

A text is cut where the tokenizer always ends a token: before white space that follows a word, and between a run of plain
letters and the punctuation after it. The stretches repeat far more often than whole texts, so their ids are remembered.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0
#: distinct stretches a process remembers; when full, it starts anew, which changes no result
REMEMBERED = 1_000_000
LONG_TEXT = 1 << 20
# fixed: the characters the tokenizer's pattern takes as white space
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PART = re.compile(f"[{_WS}]*[a-zA-ZÀ-ÖØ-öø-ÿ]+(?=[,.;:!?{_WS}]|$)|[{_WS}]*[^{_WS}]+|[{_WS}]+")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """encoder.ids(text): the ids of a text, little-endian, `width` bytes each. As a dict: stretch -> its ids."""

    def __init__(self, name: str = BYTE_BPE, remembered: int = REMEMBERED):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        # tokens that the vocabulary adds are found in a text before anything else; what is between them is encoded on its own
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: k for k, t in added.items()}
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.remembered = remembered
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        if part.isalpha() or part[0] == " " and part[1:].isalpha():    # one piece for the merges
            named = part.replace(" ", "Ġ") if part.isascii() else part.encode().decode("latin-1").translate(self.names)
            ids = [t.id for t in self.model.tokenize(named)]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        out = self[part] = array(self.kind, ids).tobytes()
        return out

    def _between(self, text: str) -> bytes:
        if len(text) < LONG_TEXT:
            return b"".join(map(self.__getitem__, _PART.findall(text)))
        return b"".join(self[m.group()] for m in _PART.finditer(text))

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=f"<u{self.width}")
        if self.cut is None or not self.cut.search(text):
            raw = self._between(text)
        elif not self.plain:
            raw = array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            parts = self.cut.split(text)                  # the added tokens stand at odd places
            raw = b"".join(array(self.kind, [self.added[x]]).tobytes() if k % 2 else self._between(x) for k, x in enumerate(parts))
        return np.frombuffer(raw, dtype=f"<u{self.width}")


_encoders: dict[str, Encoder] = {}


def encoder(name: str = BYTE_BPE) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def with_end(ids: np.ndarray, end_id: int = END_ID) -> np.ndarray:
    return np.append(ids, np.asarray(end_id, dtype=ids.dtype))
