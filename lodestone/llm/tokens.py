"""Token ids of whole texts by a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Words kept at once; further ones are encoded each time, which changes no result.  A word is
#: kept when it comes a second time: most words of a corpus come once.
CACHED_WORDS, _DOOR = 250_000, (1 << 22) - 1
_LATIN = [chr(i) for i in range(256)]
_LOWER = bytes(ord(c.lower()) for c in _LATIN)
_PROSE = bytes(i for i, c in enumerate(_LATIN) if c.isalpha() or c in "0123456789 \t\n\r\x0b\x0c.,")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe: it may start a part of its own
_PAIRS = (b"..", b".,", b",.", b",,")


def _byte_level() -> dict[int, str]:
    """The character that stands for each byte: itself if it is printable and no space, else the
    next one from U+0100 on."""
    table, spare = {}, 256
    for i, c in enumerate(_LATIN):
        if c.isprintable() and not c.isspace() and i != 0xAD:
            table[i] = c
        else:
            table[i], spare = chr(spare), spare + 1
    return table


_BYTES = _byte_level()


class Encoder(dict):
    """The ids that the tokenizer gives a text, as little-endian bytes by word.

    For lower-casing byte-level tokenizers that split at white space and between letters, digits
    and punctuation before any merge, and whose normalizer looks at neither side of a split: a
    text's ids are then those of its parts in turn.  Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._model = self._tokenizer.model
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._met = bytearray(_DOOR + 1)

    def __missing__(self, word: bytes | str) -> bytes:
        text = word.decode("latin-1") if isinstance(word, bytes) else word
        if isinstance(word, bytes) and text.isalpha():  # one part, lower-cased: the merges alone
            spelled = text if word.isascii() else text.encode().decode("latin-1").translate(_BYTES)
            found = [t.id for t in self._model.tokenize(spelled)]
        elif isinstance(word, bytes) and (core := word.rstrip(_MARKS)) != word and core.decode("latin-1").isalpha():
            return self[core] + self[word[len(core) :]]  # letters, then marks: two parts
        else:
            found = self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = array(self._code, found).tobytes()
        if len(self) < CACHED_WORDS:
            door = hash(word) & _DOOR
            if self._met[door]:
                self[word] = ids
            self._met[door] = 1
        return ids

    @staticmethod
    def _parts(text: str) -> list:
        """Parts that encode to a text's ids in turn.  Latin-1 texts are lower-cased here; where
        full stops and commas stand alone among letters and digits they become parts."""
        try:
            raw = text.encode("latin-1").translate(_LOWER)
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if not raw.translate(None, _PROSE) and not any(p in raw for p in _PAIRS):
            raw = raw.replace(b".", b" . ").replace(b",", b" , ")
        return raw.split()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self._parts(text))), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a process, whose cache outlives a task."""
    return Encoder(path)
