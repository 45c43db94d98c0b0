"""Token ids of whole texts.

The tokenizer drops white space and never joins across it, so a text is the
sequence of its words' ids. Words are encoded once per worker and remembered in
a memo of bounded size.
"""

from __future__ import annotations

import re
import sys
from array import array

if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("ids are kept as the machine's 32-bit integers, which must be little-endian")

#: The id that ends a document.
END_ID = 1
#: Marks that are always cut from letters before them.
_MARKS = ".,;:!?|$%&*#()"
#: Letters whose lower case is one letter and whose form never changes.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary spells each byte: itself if
    printable in Latin-1, else the next free letter from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordEncoder(dict):
    """From a word (UTF-8) to its ids (little-endian unsigned 32-bit).

    What is remembered has two generations of ``memo`` words: when the younger
    one is full it becomes the older one, which is forgotten. Words in use move
    back to the younger.
    """

    def __init__(self, path: str, memo: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._pieces = self._tokenizer.model.tokenize
        self._memo, self._older, self._letters, self._marks = memo, {}, {}, {}
        letters = _byte_letters()
        plain = [c for c in map(chr, range(0xC0, 0x100)) if _LATIN.fullmatch(c)]
        self._spelled = {ord(c): "".join(letters[b] for b in c.encode()) for c in plain}

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, text: str) -> bytes:
        core = text.rstrip(_MARKS)
        if core.isascii() and core.isalpha():
            spelled = core.lower()
        elif _LATIN.fullmatch(core):
            spelled = core.lower().translate(self._spelled)
        else:
            return self._whole(text)
        ids = self._letters.get(spelled)
        if ids is None:
            if len(self._letters) >= self._memo:
                self._letters.clear()
            # letters alone are one piece for the vocabulary, without further steps
            self._letters[spelled] = ids = array("I", [p.id for p in self._pieces(spelled)]).tobytes()
        marks = text[len(core) :]
        if not marks:
            return ids
        after = self._marks.get(marks)
        if after is None:
            if len(self._marks) >= self._memo:
                self._marks.clear()
            self._marks[marks] = after = self._whole(marks)
        return ids + after

    def __missing__(self, word: bytes) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._encoded(word.decode())
        if len(self) >= self._memo:
            self._older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, without an end; none for a null or empty text."""
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker; its memo lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


END = array("I", [END_ID]).tobytes()
