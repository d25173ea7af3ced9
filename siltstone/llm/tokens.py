"""Token ids of whole texts, with a cache of whitespace-free parts."""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

#: Parts that were met again (kept at hand), parts that were met once (two generations of them), and
#: characters of a part that is kept at all: 520,000 parts or some 100 MB.
KEPT_PARTS, NEW_PARTS, KEPT_LETTERS = 1 << 18, 1 << 17, 32


class Encoder(dict):
    """Ids of texts as little-endian uint32 bytes.

    The vocabulary's tokenizer lower-cases, drops white space and never joins across it, so a text's
    ids are those of its parts between spaces and newlines in order. The dict holds parts that were
    met twice; parts that are new wait in two generations, so rare ones don't drive out frequent
    ones, and memory is bounded whatever the texts. A part with capitals has
    the ids of its lower-case form if both are in the composed form that the tokenizer makes before
    it lower-cases; a full stop or comma after a letter is then an id of its own.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        #: how byte-level models write bytes: printable ones as themselves, the others from 256 on
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    @classmethod
    def of(cls, path: str) -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    @staticmethod
    def _base(part: str) -> str:
        """The part whose ids stand for this one, up to a final full stop or comma."""
        if "Σ" in part or "İ" in part or "|" in part:
            return part
        low = part.lower()
        if not part.isascii() and not (unicodedata.is_normalized("NFC", part) and unicodedata.is_normalized("NFC", low)):
            return part
        part = low
        if part[-1] in ".," and part[-2:-1].isalpha():
            part = part[:-1]
        return part

    def _ids(self, part: str) -> bytes:
        if part.isalpha() and (part.isascii() or unicodedata.is_normalized("NFC", part)) and part == part.lower() and "ſ" not in part:
            found = self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
            return array("I", [x.id for x in found]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = self.new.get(part) or self.old.get(part)
        if ids is not None:
            if len(self) >= KEPT_PARTS:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[part] = ids
            return ids
        base = self._base(part)
        if base == part:
            ids = self._ids(part)
        else:
            ids = self[base] + (self[part[-1]] if part[-1] in ".," and not base.endswith(part[-1]) else b"")
        if len(part) <= KEPT_LETTERS:
            if len(self.new) >= NEW_PARTS:
                self.old, self.new = self.new, {}
            self.new[part] = ids
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        for text in texts:
            yield b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""
