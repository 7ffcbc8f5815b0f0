"""An index of inverted lists over vectors: each row is in the list of its nearest centre, and a query looks into a few lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.functions import vectors as V
from gyre.session import ship

#: Rows that centres are fitted on at most, centres at most, rounds of fitting, and rows that the number of probes is found with.
SAMPLE, MOST_CENTRES, ROUNDS, ASKED = 20_000, 1024, 8, 200


@dataclass(frozen=True)
class Lists:
    """Unit vectors of the centres, and how many lists a query looks into."""

    centres: np.ndarray
    probes: int


def _smallest(some: DataFrame, sample: int) -> np.ndarray:
    """The vectors v with the smallest hashes, as rows; of those, the ones of the most frequent length.

    Hashes are counted by their first 12 bits, so that hardly more than the
    sample leaves the tasks, and one task, not the driver, merges what does.
    """
    first, until = F.shiftright(F.xxhash64("v"), 52), 0
    for part, n in some.groupBy(first.alias("part")).count().orderBy("part").collect():  # 4096 at most
        last, until = part, until + n
        if until >= sample:
            break
    if not until:
        return np.empty((0, 0))
    v = some.where(first <= last).orderBy(F.xxhash64("v")).limit(sample).toArrow()["v"]
    lengths = np.array(pc.list_value_length(v))
    return V.matrix_of(v.filter(pa.array(lengths == np.bincount(lengths).argmax())))


def fit_lists(rows: DataFrame, vec_col: str, k: int = 10, recall: float = 0.97, sample: int = SAMPLE, centres: int | None = None, seed: int = 7) -> Lists:
    """Centres by spherical k-means on the driver over a bounded sample of rows: those with the smallest hashes of their vectors.

    Without centres, about the root of the number of rows, MOST_CENTRES at most.
    probes is the least number of lists that hold that share of the k nearest
    neighbours, as counted for ASKED rows of the sample within it.
    """
    n = rows.count()
    some = rows.where(F.col(vec_col).isNotNull()).select(F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    held = _smallest(some, sample)
    held = held / np.maximum(np.linalg.norm(held, axis=1, keepdims=True), V.TINY)
    lists = min(len(held), centres or min(MOST_CENTRES, max(1, int(n**0.5))))
    if not lists:
        return Lists(np.empty((0, 0)), 0)
    out = held[np.random.default_rng(seed).choice(len(held), lists, replace=False)]
    for _ in range(ROUNDS):
        own = (held @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, held)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norms > V.TINY, sums / np.maximum(norms, V.TINY), out)
    own, asked = (held @ out.T).argmax(axis=1), held[:ASKED]
    near = np.argsort(-(asked @ held.T), axis=1)[:, : k + 1]
    place = np.argsort(np.argsort(-(asked @ out.T), axis=1), axis=1)  # of each list for each row
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Lists(out, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)


def assign(rows: DataFrame, index: Lists, vec_col: str) -> DataFrame:
    """Every row with its list (-1 for a row without a vector), each task's in the order of lists: the index, to be written so, as a search takes the rows of a list at once."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(index.centres)  # MOST_CENTRES vectors at most
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(names.index(vec_col)).to_pylist()
            whole = [i for i, v in enumerate(vectors) if v is not None and len(sent.value) and len(v) == sent.value.shape[1]]
            own = np.full(len(vectors), -1, np.int32)
            if whole:
                own[whole] = (np.array([vectors[i] for i in whole], float) @ sent.value.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*names, "list"])

    return rows.mapInArrow(place, schema).sortWithinPartitions("list")


def search_lists(queries: DataFrame, lists: DataFrame, index: Lists, k: int, query_id: str = "qid", query_vec: str = "qvec", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id_col, score): the k nearest by cosine among the rows in the lists that are nearest to a query.

    Rows meet the queries that look into their list where they lie: a task keeps
    k rows a query, so that pairs are neither joined nor shuffled. Queries are
    asked in blocks, as in nearest().
    """
    centres, many = index.centres, index.probes

    @F.pandas_udf("array<int>")
    def nearest_lists(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.argsort(-(np.array(v, float) @ centres.T), kind="stable")[:many].tolist() for v in vectors])

    ship(queries.sparkSession)
    # a query of another length than the centres has no lists
    asked = queries.where(F.size(query_vec) == centres.shape[1]).select(query_id, query_vec, nearest_lists(query_vec).alias("list"))
    return V.nearest(asked, lists, k, "cosine", query_id, query_vec, id_col, vec_col, group="list", own=True).drop("rank")
