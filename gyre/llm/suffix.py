"""Removal of long byte strings, or runs of words, that occur more than once.

Windows of the full length are found by difference-cover anchors: stretches at
cover positions are named by hashes (see names and repeats), those that repeat
select the windows around them, and windows with equal names are removed. No
order of suffixes is built here: the named method, with ranks, merge and
adjacent prefixes, is in suffix_order and gives the same result; README says
with figures why the query doesn't take it. Equality is that of 64-bit hashes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gyre.llm.repeats import removed, search, span_column
from gyre.llm.words import split

#: The period of the difference cover for the default length; samples are named at length - period + 1.
PERIOD = 133

#: The same for words.
WORD_PERIOD = 21

OUTPUTS = ("n_bytes", "n_removed", "spans", "kept")
PASSAGE_OUTPUTS = ("n_words", "n_removed", "spans", "kept")

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans, concatenated."""
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def byte_spans(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans of words as spans of bytes."""
    if not len(spans):
        return spans
    words = [m.span() for m in _WORD.finditer(text)]
    return np.array([(words[a][0], words[b - 1][1]) for a, b in spans.tolist()])


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _schema(outputs: tuple[str, ...], kept: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in zip(outputs, (T.LongType(), T.LongType(), _SPAN, kept), strict=True)])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, period: int | None = None) -> DataFrame:
    """Each row of docs with what is left of its text once every byte is removed
    that a string of length bytes covers which also starts anywhere else, in the
    same document or another.

    Texts are UTF-8 bytes, matches never cross documents, strings are judged on
    the input. Adds n_bytes, n_removed (long), spans (removed runs as
    array<struct<start,end>>) and kept (binary); columns of docs with these
    names (without case) are replaced. Ids are integers. A null text is empty,
    a null id is an id like another; repeated rows are copies of each other; an
    empty table gives no rows.
    """
    period = period or min(PERIOD, max(7, length // 3))

    def finish(spans: list[np.ndarray], texts: list[bytes]) -> list[pa.Array]:
        kept = pa.array([kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary())
        return [pa.array([len(t) for t in texts], pa.int64()), removed(spans), span_column(spans), kept]

    return search(docs, finish, _schema(OUTPUTS, T.BinaryType()), id_col=id_col, text_col=text_col, kind="byte", window=length, period=period, earlier=False)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, period: int | None = None) -> DataFrame:
    """As remove_repeated_bytes, with words as the symbols: what a run of words
    covers goes that also starts anywhere else, from the first byte of its first
    word to the last of its last one, so that no character or word is cut.

    Words are runs of bytes other than ASCII white space, compared unchanged;
    what stands between them doesn't count. Adds n_words, n_removed (words),
    spans (of bytes) and kept (string). Nulls, repeated rows, empty tables and
    clashing names as in remove_repeated_bytes.
    """
    period = period or min(WORD_PERIOD, max(7, words // 2))

    def finish(spans: list[np.ndarray], texts: list[bytes]) -> list[pa.Array]:
        found = [byte_spans(t, s) for t, s in zip(texts, spans, strict=True)]
        kept = pa.array([kept_bytes(t, s).decode() for t, s in zip(texts, found, strict=True)], pa.string())
        return [pa.array([len(split(t)) for t in texts], pa.int64()), removed(spans), span_column(found), kept]

    return search(docs, finish, _schema(PASSAGE_OUTPUTS, T.StringType()), id_col=id_col, text_col=text_col, kind="word", window=words, period=period, earlier=False)
