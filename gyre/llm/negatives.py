"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells; a row of the file has a byte for each
dimension, its cell, beside the vector. For an anchor, a table gives the least
and the largest contribution of each cell of a dimension; the sums of what the
cells of a row give are bounds of its score. Only rows whose bounds let them
into a window are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.session import materialize, ship

#: Cells of a dimension (a byte at most), rows that their edges are fitted on, anchors that one pass answers.
CELLS, FIT_ROWS, BLOCK = 64, 20_000, 4096
#: Rows and anchors that are looked up together.
ROWS, PART = 1024, 256


def quantised(vectors: DataFrame, id_col: str, label_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, label, vec): components are floor(scale * x) as integers; without rows that lack a label, a vector or a finite component.

    Vectors of another length than the most frequent one (of equals the
    shortest) and vectors without components take no part.
    """
    v = F.col(f"`{vec_col}`")
    good = F.col(f"`{label_col}`").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(F.isnan(x) | F.isnull(x) | x.isin(float("inf"), float("-inf")), F.lit(True)))
    rows = vectors.where(good & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = lengths[0] if lengths else 0
    return rows.where(F.size("v") == n).select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def cell_edges(rows: DataFrame, cells: int = CELLS, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, low, high): the first value of each cell but the first, and the ends of all cells, by dimension.

    Edges are quantiles of at most fit_rows rows, those with the smallest hashes
    of their id. The outer cells end at the least and largest component of all
    rows, so that bounds hold for each.
    """
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vec").toArrow()["vec"].combine_chunks()
    sample = _matrix(sample, np.int64)
    edges = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="higher").T.copy()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), np.int64)
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int64()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    of_all = rows.select("vec").mapInArrow(ends, "d long, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).orderBy("d").collect()  # a row for each dimension
    first, last = np.array([[r[1]] for r in of_all]), np.array([[r[2]] for r in of_all])
    return edges, np.concatenate([np.minimum(first, edges[:, :1]), edges], axis=1), np.concatenate([np.maximum(edges - 1, first), np.maximum(last, edges[:, -1:])], axis=1)


def cell_of(matrix: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cells of each row's components."""
    return np.stack([np.searchsorted(edges[d], matrix[:, d], side="right") for d in range(matrix.shape[1])], axis=1).astype(np.uint8)


def bound_tables(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each dimension and cell the least and the largest contribution to each anchor's score: (dimension, cell, anchor)."""
    peak = int(np.abs(anchors).max(initial=0)) * int(max(np.abs(low).max(), np.abs(high).max())) * len(low)
    kind = np.int32 if peak < 1 << 31 else np.int64
    a, b = (x.astype(kind)[:, :, None] * anchors.astype(kind).T[:, None, :] for x in (low, high))
    return np.minimum(a, b), np.maximum(a, b)


def bounds(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what each row's cells give: (row, anchor) least and largest scores."""
    out = []
    for table in tables:
        total = table[0][cells[:, 0]]
        for d in range(1, cells.shape[1]):
            total += table[d][cells[:, d]]
        out.append(total)
    return out[0], out[1]


def approximation_file(rows: DataFrame, edges: np.ndarray, keep: int) -> DataFrame:
    """(label, ids, cells, vec), written: equal vectors of a label are a row with the keep smallest of their ids.

    No list of fewer than keep rows can hold another of these ids, as equal
    vectors have equal scores and the smaller ids come first. The copies are cut
    within each task before the shuffle.
    """
    same = Window.partitionBy("label", "vec").orderBy("id")
    few = rows.distinct().withColumn("k", F.row_number().over(same)).where(F.col("k") <= keep)
    classes = few.groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = cell_of(_matrix(batch.column("vec"), np.int64), edges)
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("ids"), pa.array([x.tobytes() for x in found], pa.binary()), batch.column("vec")], names=["label", "ids", "cells", "vec"])

    kind = rows.schema["label"].dataType.simpleString()
    return materialize(classes.select("label", "ids", "vec").mapInArrow(approximate, f"label {kind}, ids array<long>, cells binary, vec array<long>"), "approximations")


class Best:
    """For each window its first k rows (score falling, id rising) so far; tells what can still enter."""

    def __init__(self, k: int, windows: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * windows
        self.id = [np.empty(0, np.int64)] * windows
        #: the last score that a full window holds
        self.floor = np.full(windows, np.iinfo(np.int64).min)

    def add(self, window: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score[window], score], np.r_[self.id[window], ids]
        if not len(score):
            return
        order = np.lexsort((ids, -score))
        score, ids = score[order], ids[order]
        order = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])])[: self.k]
        self.score[window], self.id[window] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[window] = score[order[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = [len(x) for x in self.score]
        return np.repeat(np.arange(len(n)), n), np.concatenate(self.id), np.concatenate(self.score)


def _kth(least: np.ndarray, k: int) -> int:
    """The k-th largest of the least scores of rows that surely count: what can't reach it has k rows before it."""
    return int(np.partition(least, -k)[-k]) if len(least) >= k else np.iinfo(np.int64).min


def search(batch: pa.RecordBatch, best: Best, anchors: np.ndarray, anchor_label: list, anchor_id: np.ndarray, ends: tuple[np.ndarray, np.ndarray], of_anchor: list[np.ndarray], low: np.ndarray | None, high: np.ndarray | None) -> int:
    """Let the rows of a batch into the windows of the anchors; returns how many pairs were scored exactly.

    ends: the ends of all cells; of_anchor: the windows of each anchor. With low and high a window takes rows
    of other labels with scores from low to high; without, other rows of its
    anchor's label.
    """
    code = {x: i for i, x in enumerate(dict.fromkeys(anchor_label))}
    label = np.array([code.get(x, -1) for x in batch.column("label").to_pylist()])
    sought = np.array([code[x] for x in anchor_label])
    ids = batch.column("ids").to_pylist()
    matrix = _matrix(batch.column("vec"), np.int64)
    cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(matrix.shape)
    scored = 0
    for lo in range(0, len(anchors), PART):
        least, most = bounds(cells, bound_tables(anchors[lo : lo + PART], *ends))
        alike = label[:, None] == sought[None, lo : lo + PART]
        for a in range(lo, min(lo + PART, len(anchors))):
            windows = of_anchor[a]
            if not len(windows):
                continue
            down, up = least[:, a - lo], most[:, a - lo]
            if low is None:
                mine = alike[:, a - lo]
                # one of the rows may be the anchor itself
                floor = max(best.floor[windows[0]], _kth(down[mine], best.k + 1))
                at = np.flatnonzero(mine & (up >= floor))
            else:
                sure = [_kth(down[~alike[:, a - lo] & (down >= low[w]) & (up <= high[w])], best.k) for w in windows]
                enter = np.maximum(np.maximum(low[windows], best.floor[windows]), sure)
                # of all windows of an anchor at once, then of each
                at = np.flatnonzero(~alike[:, a - lo] & (up >= enter.min()) & (down <= high[windows].max()))
                if len(at):
                    at = at[((up[at, None] >= enter) & (down[at, None] <= high[windows])).any(axis=1)]
            if not len(at):
                continue
            scored += len(at)
            exact = matrix[at] @ anchors[a]
            n = [len(ids[r]) for r in at]
            score, own = np.repeat(exact, n), np.array([i for r in at for i in ids[r]], np.int64)
            if low is None:
                other = own != anchor_id[a]
                best.add(windows[0], score[other], own[other])
                continue
            for w in windows:
                inside = (score >= low[w]) & (score <= high[w]) & (score >= best.floor[w])
                if inside.any():
                    best.add(w, score[inside], own[inside])
    return scored


def _passes(file: DataFrame, windows: DataFrame, k: int, low: np.ndarray, high: np.ndarray, block: int) -> DataFrame:
    """(window, id, score): of each task the first k rows of each window. windows: (window, anchor_id, label, vec), and (from, to) if rows of other labels are sought.

    A block of anchors is sent to all tasks, a stated set of at most about so many rows.
    """
    spark = file.sparkSession
    bounded = "from" in windows.columns

    def ask(own: DataFrame) -> DataFrame:
        held = own.orderBy("anchor_id", "window").toArrow()
        if not held.num_rows:
            return spark.createDataFrame([], "window string, id long, score long")
        names = held["window"].to_pylist()
        key = list(zip(held["anchor_id"].to_pylist(), held["label"].to_pylist(), map(tuple, held["vec"].to_pylist()), strict=True))
        place = {x: i for i, x in enumerate(dict.fromkeys(key))}
        of_anchor = [[] for _ in place]
        for w, x in enumerate(key):
            of_anchor[place[x]].append(w)
        ends = [held[c].to_numpy() for c in ("from", "to")] if bounded else [None, None]
        sent = spark.sparkContext.broadcast((names, np.array([x[2] for x in place], np.int64), [x[1] for x in place], np.array([x[0] for x in place], np.int64), [np.array(x) for x in of_anchor], *ends, low, high))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, anchors, label, ids, of_anchor, start, stop, low, high = sent.value
            best = Best(k, len(names))
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    search(batch.slice(lo, ROWS), best, anchors, label, ids, (low, high), of_anchor, start, stop)
            window, found, score = best.rows()
            if len(window):
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(window)), pa.array(found), pa.array(score)], names=["window", "id", "score"])

        return file.mapInArrow(find, "window string, id long, score long")

    blocks = max(1, -(-windows.select("anchor_id").distinct().count() // block))
    share = F.pmod(F.xxhash64("anchor_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (ask(windows.where(share == i) if blocks > 1 else windows) for i in range(blocks)))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("window").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", n_positives: int = 5, n_negatives: int = 5, percent: int = 80, scale: float = 256.0, cells: int = CELLS, block: int = BLOCK
) -> DataFrame:
    """For each anchor (a row where the condition anchor holds) and each of its first n_positives other rows of the
    same label, the first n_negatives rows of other labels whose scores are between percent of the positive's score
    and that score: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x); a score is the inner product of these, in
    integers. Higher scores come first, of equal ones the smaller id. A window of
    a negative positive score is empty. Rows without id, label or vector, with a
    null or non-finite component, or of another length than most, take no part.
    Equal rows (id, label, vector) count once; rows of one id that differ are
    rows of their own, none of which is another row to an anchor of that id; of
    equal scores and ids one is returned. Columns beside the three don't matter;
    an empty table, or one without anchors, gives no rows. A score must fit in 64
    bits: else ValueError. The anchors are sent out in blocks, so the corpus is
    read twice for each block.
    """
    ship(vectors.sparkSession)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = quantised(vectors, id_col, label_col, vec_col, scale)
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], empty)
    edges, low, high = cell_edges(rows, cells)
    if int(max(-low.min(), high.max())) ** 2 * len(low) >= 1 << 62:
        raise ValueError("scores don't fit in 64 bits")
    file = approximation_file(rows, edges, max(n_positives, n_negatives) + 1)
    asked = quantised(vectors.where(anchor), id_col, label_col, vec_col, scale)
    asked = asked.where(F.size("vec") == len(low)).distinct().select(F.col("id").alias("anchor_id"), "label", "vec")
    asked = materialize(asked.withColumn("window", F.concat_ws(":", F.col("anchor_id").cast("string"), F.xxhash64("label", "vec").cast("string"))), "anchors")
    positives = _first(_passes(file, asked, n_positives, low, high, block), n_positives)
    pairs = positives.join(asked, "window").where("score >= 0")
    pairs = pairs.select(F.concat_ws(":", "window", F.col("id").cast("string")).alias("window"), "anchor_id", "label", "vec", F.col("id").alias("positive_id"), F.col("score").alias("to"))
    # percent * score <= 100 * x in whole numbers
    pairs = materialize(pairs.withColumn("from", F.expr(f"(to * {percent} + 99) div 100")), "windows")
    negatives = _first(_passes(file, pairs.drop("positive_id"), n_negatives, low, high, block), n_negatives)
    out = negatives.join(pairs.select("window", "anchor_id", "positive_id", F.col("to").alias("positive_score")), "window")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
