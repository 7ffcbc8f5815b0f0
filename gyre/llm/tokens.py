"""Byte-level BPE ids of whole texts, from a cache of the ids of stretches between spaces."""

from __future__ import annotations

import base64
import json
import re
from array import array

import public_tokenizers
import tiktoken

# Unicode white space, as the public pre-tokenizer's pattern has it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Stretches that a cache holds at most.
MOST = 400_000

# a space that white space or the end follows belongs to a run, which must stay whole
_RUN = re.compile(f" (?:[{SPACES}]|\\Z)")


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer is; the same on all machines."""
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 characters for themselves, then code points from 256 on for the rest."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Cache(dict):
    """Ids of stretches behind a prefix (a space, or nothing). Full, it keeps what it has: frequent stretches come early."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, stretch: str) -> bytes:
        value = array("I", self.encode(self.prefix + stretch)).tobytes()
        if len(self) < MOST and len(stretch) < 200:
            self[stretch] = value
        return value


class Encoder:
    """Ids of texts, four bytes each, little-endian.

    path: a vocabulary file of the tokenizers library (byte-level BPE without
    prefix space, whose ids follow the order of merges) or its tiktoken twin.
    The pre-tokenizer's pattern breaks before every single space that something
    else than white space follows, so that stretches can be encoded apart.
    """

    def __init__(self, path: str):
        self.added: dict[str, bytes] = {}
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        else:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)
            of = byte_alphabet()
            for x in model["added_tokens"]:
                if any(x[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                    raise ValueError(f"added token {x['content']!r}: only plain literals are supported")
                self.added[x["content"]] = x["id"].to_bytes(4, "little")
            ranks = {bytes(of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in self.added}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.plain, self.spaced = _Cache(encode, ""), _Cache(encode, " ")
        # the longest of those that start at a place
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._between(text)
        return b"".join(self.added[x] if i % 2 else self._between(x) for i, x in enumerate(self.cut.split(text)))

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if not text:
            return b""
        if _RUN.search(text):
            out, at = [], 0
            for m in _BREAK.finditer(text):
                out.append(self.plain[text[at : m.start()]])
                at = m.start()
            return b"".join([*out, self.plain[text[at:]]])
        first, *rest = text.split(" ")
        rest = b"".join(map(self.spaced.__getitem__, rest))
        return self.plain[first] + rest if first else rest


# a single break point: a space before something else than white space
_BREAK = re.compile(f"(?<!\\A) (?=[^{SPACES}])")
