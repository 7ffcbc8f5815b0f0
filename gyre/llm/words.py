"""Words as runs of bytes other than ASCII white space, and their hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from gyre.session import trim

#: Entries after which a worker's cache of word hashes starts anew.
_MOST = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def split(text: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`: bytes.split() takes just these bytes as white space."""
    return text.split()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of the text."""
    words = text.split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def forget() -> None:
    """Empty the cache and give its memory back, at the end of a task."""
    _hashes.clear()
    trim()
