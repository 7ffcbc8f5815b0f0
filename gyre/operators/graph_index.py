"""An index of neighbour graphs over vectors: each shard is a graph, which a query walks from a few entries towards what is nearest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyre.functions import vectors as V
from gyre.session import ship

#: Rows of a shard about, links of a row, rows that a walk keeps in view, rounds of building, queries of one pass.
SHARD, LINKS, VIEW, ROUNDS, BLOCK = 20_000, 16, 64, 6, 10_000


def _units(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > V.TINY)


def neighbours(units: np.ndarray, links: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """n x links rows near each row, by neighbour descent: in each round a row's candidates are the neighbours of its neighbours, those that have it as one, and a few at random."""
    n = len(units)
    links = min(links, n - 1)
    if links < 1:
        return np.zeros((n, 0), np.int64)
    r = np.random.default_rng(seed)
    near = r.integers(0, n - 1, (n, links))
    near += near >= np.arange(n)[:, None]
    for _ in range(rounds):
        back = np.argsort(near.ravel(), kind="stable") // links
        starts = np.searchsorted(np.sort(near.ravel()), np.arange(n + 1))
        turned = np.stack([back[np.minimum(starts[:-1] + k, len(back) - 1)] for k in range(links)], axis=1)
        turned = np.where(np.arange(links)[None, :] < np.diff(starts)[:, None], turned, near)
        both = np.concatenate([near, turned], axis=1)
        out = np.empty_like(near)
        for lo in range(0, n, 512):
            own = np.arange(lo, min(n, lo + 512))
            found = np.concatenate([both[own], both[near[own]].reshape(len(own), -1), r.integers(0, n, (len(own), links))], axis=1)
            found.sort(axis=1)
            score = np.einsum("ij,ikj->ik", units[own], units[found])
            again = np.concatenate([np.zeros((len(own), 1), bool), found[:, 1:] == found[:, :-1]], axis=1)
            score[again | (found == own[:, None])] = -np.inf
            best = np.argpartition(-score, links - 1, axis=1)[:, :links]
            out[own] = np.take_along_axis(found, best, axis=1)
        near = out
    return near


def graph_index(rows: DataFrame, id_col: str, vec_col: str, shard: int = SHARD, links: int = LINKS) -> DataFrame:
    """(shard, id_col, vec_col, links): every row with a vector, in shards of about so many rows by a hash of the id; links are places in the shard's order.

    A shard's graph is built by one task, whose memory a shard bounds. Write it
    before searching. Vectors must be of one length.
    """
    ship(rows.sparkSession)
    held = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.transform(vec_col, lambda x: x.cast("float")).alias(vec_col))
    shards = max(1, -(-held.count() // shard))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(id_col)
        m = V.matrix_of(table[vec_col])
        near = neighbours(_units(m), links)
        return table.append_column("links", pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())))

    dealt = held.withColumn("shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).select("shard", id_col, vec_col)
    return dealt.groupBy("shard").applyInArrow(build, f"shard int, {id_col} long, {vec_col} array<float>, links array<int>")


def walk(units: np.ndarray, near: np.ndarray, query: np.ndarray, entries: np.ndarray, view: int) -> np.ndarray:
    """Rows that a walk sees nearest to a query: the best of those in view that is still open opens its links, until none is left."""
    seen = np.zeros(len(units), bool)
    seen[entries] = True
    rows, score = entries, units[entries] @ query
    opened = np.zeros(len(entries), bool)
    while True:
        order = np.argsort(-score, kind="stable")[:view]
        rows, score, opened = rows[order], score[order], opened[order]
        ahead = np.flatnonzero(~opened)[:8]
        if not len(ahead):
            return rows
        opened[ahead] = True
        fresh = np.unique(near[rows[ahead]].ravel())
        fresh = fresh[~seen[fresh]]
        seen[fresh] = True
        rows, score, opened = np.r_[rows, fresh], np.r_[score, units[fresh] @ query], np.r_[opened, np.zeros(len(fresh), bool)]


def _found_in_shard(sent, k: int, id_col: str, vec_col: str, query_id: str, view: int):
    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(id_col)
        names, asked = sent.value
        ids = table[id_col].to_numpy()
        units = _units(V.matrix_of(table[vec_col]))
        near = np.array(table["links"].to_pylist(), np.int64).reshape(len(ids), -1)
        # as many entries as the root of the rows, spread over the order of ids
        entries = np.unique(np.linspace(0, len(ids) - 1, max(view, int(len(ids) ** 0.5))).astype(np.int64))
        rows = [walk(units, near, q, entries, max(view, k))[:k] for q in asked]
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        who = np.repeat(np.arange(len(asked)), [len(r) for r in rows])
        score = np.einsum("ij,ij->i", units[at], asked[who]) if len(at) else np.empty(0)
        return pa.table({query_id: names.take(pa.array(who)), id_col: pa.array(ids[at]), "score": pa.array(score)})

    return find


def search_graph(queries: DataFrame, index: DataFrame, k: int, id_col: str, vec_col: str, query_id: str = "qid", query_vec: str = "qvec", view: int = VIEW) -> DataFrame:
    """(query_id, id_col, score, rank): about the k rows of the index with the largest cosine. Queries are a stated set of at most BLOCK rows a pass; each walks every shard's graph."""
    ship(index.sparkSession)
    spark = index.sparkSession
    kind = queries.schema[query_id].dataType.simpleString()
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for b in range(blocks):
        held = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).select(query_id, query_vec).toArrow()  # about BLOCK rows
        sent = spark.sparkContext.broadcast((held[query_id].combine_chunks(), _units(V.matrix_of(held[query_vec])) if held.num_rows else np.empty((0, 0))))

        found = index.groupBy("shard").applyInArrow(_found_in_shard(sent, k, id_col, vec_col, query_id, view), f"{query_id} {kind}, {id_col} long, score double")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
