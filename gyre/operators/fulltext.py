"""Full text search: an inverted index with positions, questions of words that must all occur, and a rank by their closeness.

The rank is that of the public definition behind ts_rank without normalisation:
each two occurrences of different lexemes at a distance of d words add
w = 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2))) by r = 1 - (1 - r)(1 - w);
a single lexeme that occurs n times has 0.1 * (1 + 1/4 + ... + 1/n^2) / 1.64493406685.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions.english import lexeme
from gyre.session import materialize, ship, sized

#: Distances over this add less than 1e-16 each.
REACH = 100
WEIGHT = 0.1
_WORD = re.compile(r"[^\W_]+")


def positions_of(text: str) -> dict[str, list[int]]:
    """Lexemes of a text with their places among all its words, stop words included, from 1."""
    out: dict[str, list[int]] = {}
    for place, word in enumerate(_WORD.findall(text.lower()), 1):
        found = lexeme(word)
        if found is not None:
            out.setdefault(found, []).append(place)
    return out


def inverted_index(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id_col, lexeme, positions) for each lexeme of each text; a null text has none.

    A text is split where it lies: a row leaves for each of its different
    lexemes, not for each word.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [positions_of(t or "") for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            words = [w for x in found for w in x]
            places = [p for x in found for p in x.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=[id_col, "lexeme", "positions"])

    return docs.select(id_col, text_col).mapInArrow(index, f"{id_col} {kind}, lexeme string, positions array<int>")


def closeness(lists: list[np.ndarray]) -> float:
    """The rank of a text in which the lexemes of a question stand at these places."""
    if len(lists) == 1:
        return float(WEIGHT * (1 / np.arange(1, len(lists[0]) + 1) ** 2).sum() / 1.64493406685)
    place = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(place)
    place, owner = place[order], owner[order]
    left = 0.0
    # words have places of their own, so no two are nearer in the list than in the text
    for step in range(1, min(REACH, len(place) - 1) + 1):
        distance = place[step:] - place[:-step]
        near = distance[(distance <= REACH) & (owner[step:] != owner[:-step])]
        if len(near):
            left += np.log1p(-WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(near / 1.5 - 2)))).sum()
        elif (distance > REACH).all():
            break
    return float(-np.expm1(left))


def full_text_search(index: DataFrame, questions: DataFrame, id_col: str, question_id: str, k: int | None = None) -> DataFrame:
    """(question_id, id_col, score[, rank]) for texts of an index that have all lexemes of a question (question_id, text).

    k: only the k best of each, ties by id. Questions without a lexeme, or with
    one that no text has, have no answers. Each question starts from the texts
    of its rarest lexeme, and only these are looked up for the others, so that
    frequent lexemes are never joined with all their texts.
    """
    ship(index.sparkSession)
    asked = materialize(inverted_index(questions, question_id).select(question_id, "lexeme"), "asked")
    only = asked.select("lexeme").distinct()
    # the part of the index that is asked for
    part = materialize(index.join(sized(only), "lexeme", "left_semi"), "postings")
    counts = part.groupBy("lexeme").agg(F.count("*").alias("texts"))
    known = asked.join(counts, "lexeme", "left").select(question_id, "lexeme", F.coalesce("texts", F.lit(0)).alias("texts"))
    rare = known.groupBy(question_id).agg(F.min(F.struct("texts", "lexeme")).alias("x"), F.count("*").alias("n")).where("x.texts > 0")
    first = rare.select(question_id, F.col("x.lexeme").alias("lexeme"), "n").join(part.select("lexeme", id_col), "lexeme").select(question_id, id_col, "n")
    sought = first.join(asked, question_id)
    both = sought.join(part, [id_col, "lexeme"])
    full = both.groupBy(question_id, id_col, "n").agg(F.sort_array(F.collect_list(F.struct("lexeme", "positions"))).alias("x")).where(F.size("x") == F.col("n"))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return column.map(lambda lists: closeness([np.asarray(x, np.int64) for x in lists]))

    out = full.select(question_id, id_col, score(F.col("x.positions")).alias("score"))
    if k is None:
        return out
    order = Window.partitionBy(question_id).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
