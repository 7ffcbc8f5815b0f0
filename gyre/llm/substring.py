"""Removal of long word sequences that an earlier document has too.

Difference-cover anchors: windows are hashed at cover positions modulo a period
only. Any two equal windows share an aligned anchor at some shift below the
period; from the anchors that repeat, the search extends to all windows around
them and confirms these at full length (see repeats).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gyre.llm.repeats import removed, search, span_column
from gyre.llm.words import split

PERIOD = 21

OUTPUTS = ("n_words", "n_removed", "spans", "kept")


def kept_words(text: bytes, spans: np.ndarray) -> bytes:
    """The words outside the spans, joined by one space."""
    words = split(text)
    at, out = 0, []
    for a, b in spans.tolist():
        out += words[at:a]
        at = b
    return b" ".join([*out, *words[at:]])


def remove_earlier_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int | None = None) -> DataFrame:
    """Each row of docs with the words left once every word is removed that a
    window of consecutive words covers whose sequence also starts in a document
    with a smaller id.

    Windows lie in one document and are judged on the input. Adds n_words,
    n_removed (long), spans (removed runs of words) and kept (string: the words
    left, joined by one space); columns of docs with these names (without case)
    are replaced. Ids are integers. A null text has no words; a null id counts
    as larger than all others; rows that share an id do not remove each other's
    words; an empty table gives no rows.
    """
    period = period or min(PERIOD, max(7, window // 2))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(n, t) for n, t in zip(OUTPUTS, (T.LongType(), T.LongType(), span, T.StringType()), strict=True)])

    def finish(spans: list[np.ndarray], texts: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(split(t)) for t in texts], pa.int64()),
            removed(spans),
            span_column(spans),
            pa.array([kept_words(t, s).decode() for t, s in zip(texts, spans, strict=True)], pa.string()),
        ]

    return search(docs, finish, schema, id_col=id_col, text_col=text_col, kind="word", window=window, period=period, earlier=True)
