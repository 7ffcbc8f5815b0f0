"""Vector arithmetic on array columns in double precision, and searches by blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as from_spark

from gyre.session import ship, trim

#: Norms below this count as zero.
TINY = 1e-8


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is tiny."""
    return F.when((norm(a) < TINY) | (norm(b) < TINY), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def cosine_of(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine() of vectors whose norms are known."""
    return F.when((norm_a < TINY) | (norm_b < TINY), F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def list_cosine(a: Column, b: Column) -> Column:
    """Cosine that is 0 only for a norm of zero; vectors of different length raise an error."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors must have the same length")).cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x)


def to_bytes(vec_col: str, half: bool) -> Column:
    """A vector as little-endian floats of half or single precision."""
    kind = "<f2" if half else "<f4"

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(kind).tobytes())

    return pack(vec_col)


def from_bytes(bytes_col: str, half: bool) -> Column:
    """The vector that to_bytes wrote, in single precision."""
    kind = "<f2" if half else "<f4"

    @F.pandas_udf("array<float>")
    def unpack(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else np.frombuffer(b, kind).astype(np.float32))

    return unpack(bytes_col)


def normalized(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(TINY)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))


def quantized(a: Column) -> Column:
    """Codes 0 to 255 with scale and zero, so that zero + code * scale approximates an element."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    scale = F.greatest((hi - lo) / 255, F.lit(1e-12))
    return F.struct(F.transform(a, lambda x: F.round((x.cast("double") - lo) / scale).cast("int")).alias("codes"), scale.alias("scale"), lo.alias("zero"))


#: Queries that one pass over the corpus answers, and of these those that a batch is multiplied with at once.
BLOCK, PART = 10_000, 512
#: Pairs that are measured at once, so that a task's memory grows neither with the rows nor with the queries.
PAIRS = 1 << 15


def _exact(metrics: tuple[str, ...], rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """The measures of each row with the query beside it, in one order of summation for all."""
    dots, out = None if metrics == ("l2",) else np.einsum("ij,ij->i", rows, queries), []
    for metric in metrics:
        if metric == "l2":
            d = rows - queries
            out.append(np.sqrt(np.einsum("ij,ij->i", d, d)))
        elif metric == "ip":
            out.append(-dots)
        else:
            norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (rows, queries)]
            tiny = (norms[0] < TINY) | (norms[1] < TINY)
            out.append(np.where(tiny, 0.0, dots / np.where(tiny, 1.0, norms[0] * norms[1])))
    return out


def _every(metrics: tuple[str, ...], rows: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """The measures of all rows with all queries, a row of each array for a row."""
    dots, out = None if metrics == ("l2",) else np.einsum("ij,kj->ik", rows, queries), []
    for metric in metrics:
        if metric == "l2":
            d = rows[:, None, :] - queries[None, :, :]
            out.append(np.sqrt(np.einsum("ikj,ikj->ik", d, d)))
        elif metric == "ip":
            out.append(-dots)
        else:
            norms = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (rows, queries)]
            tiny = (norms[0] < TINY)[:, None] | (norms[1] < TINY)[None, :]
            out.append(np.where(tiny, 0.0, dots / np.where(tiny, 1.0, norms[0][:, None] * norms[1][None, :])))
    return out


def _near(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The measures of all rows with all queries by one product of matrices, the nearer the larger; exact but for the last digits."""
    dots = rows @ queries.T
    if metric == "ip":
        return dots
    squares = [np.einsum("ij,ij->i", x, x) for x in (rows, queries)]
    if metric == "l2":
        return 2 * dots - squares[0][:, None] - squares[1][None, :]
    norms = [np.where((n := np.sqrt(x)) < TINY, np.inf, n) for x in squares]
    return dots / norms[0][:, None] / norms[1][None, :]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, as rows."""
    return _matrix(column.combine_chunks())


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, object]]:
    """The ids and vectors of a batch for each value of its third column."""
    ids, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1))
    coded = batch.column(2).dictionary_encode()
    values = [*coded.dictionary.to_pylist(), *([None] if coded.null_count else [])]
    if len(values) == 1:
        yield ids, matrix, values[0]
        return
    code = coded.indices.fill_null(len(values) - 1).to_numpy()
    for k, value in enumerate(values):
        at = np.flatnonzero(code == k)
        yield ids[at], matrix[at], value


def _scored(queries: DataFrame, corpus: DataFrame, metric: str, query_id: str, query_vec: str, id_col: str, vec_col: str, most_queries: int, *, k: int | None = None, least: float | None = None, group: str | None = None, own: bool = False, also: str | None = None) -> DataFrame:
    """(query_id, id_col, score[, group][, also]): of each task the k best rows of a query, or all (of least at least).

    group: a column of the corpus; the k best are those of each of its values.
    also: a second measure of the same pairs, in a column of its name; only where all are asked for.
    own: a column of the queries as well, or an array of such values; only rows of a query's own values count, and the k best are those of all of these.

    Queries are a stated set, asked in blocks of most_queries; the corpus is
    read once a block, in Arrow batches, and each batch meets a part of the
    block in a product of matrices. Rows and queries without a vector, or with
    another number of elements than the first query, take no part.
    """
    ship(corpus.sparkSession)
    spark = corpus.sparkSession
    first = queries.where(F.col(query_vec).isNotNull()).select(F.size(query_vec)).first()
    size = first[0] if first else 0
    scope = F.col(group) if group else F.lit(0).alias("_group")
    several = own and isinstance(queries.schema[group].dataType, T.ArrayType)
    asked = queries.where(F.size(query_vec) == size).select(query_id, F.transform(query_vec, lambda x: x.cast("double")).alias(query_vec), (scope if several else F.array(scope)) if own else F.lit(None).alias("_any"))
    rows = corpus.where(F.size(vec_col) == size).select(F.col(id_col).cast("long").alias(id_col), vec_col, scope)
    kind = queries.schema[query_id].dataType
    schema = T.StructType([T.StructField(query_id, kind), T.StructField(id_col, T.LongType()), T.StructField("score", T.DoubleType()), T.StructField(group or "_group", rows.schema[2].dataType), *([T.StructField(also, T.DoubleType())] if also else [])])
    metrics = (metric, also) if also else (metric,)

    def ask(block: DataFrame) -> DataFrame:
        held = block.collect()  # most_queries rows at most, about
        of_value: dict[object, list[int]] = {}  # the places of the queries that a value belongs to
        for i, value in ((i, value) for i, r in enumerate(held) if own for value in r[2] or ()):
            of_value.setdefault(value, []).append(i)
        scopes = {value: np.array(i, np.int64) for value, i in of_value.items()}
        sent = spark.sparkContext.broadcast(([r[0] for r in held], np.array([r[1] for r in held], float).reshape(len(held), size), scopes))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, every, scopes = sent.value
            arrow, scope_kind = pa.array(names, from_spark(kind)), from_spark(schema[3].dataType)
            best: dict[tuple[int, object], list[np.ndarray]] = {}
            floors: dict[object, np.ndarray] = {}  # what a row must come near, once a query has k
            for ids, matrix, value in (x for batch in batches for x in _by_group(batch)):
                mine = scopes.get(value, np.empty(0, np.int64)) if own else np.arange(len(names))
                vectors = every[mine]
                value = None if own else value  # a query's values share its k best
                for lo in range(0, len(mine), PART):
                    part = vectors[lo : lo + PART]
                    if k is None:
                        step = max(1, PAIRS // len(part))
                        for a in range(0, len(ids), step):
                            some = matrix[a : a + step]
                            if least is None:
                                exact = [x.ravel() for x in _every(metrics, some, part)]
                                row, q = np.repeat(np.arange(len(some)), len(part)), np.tile(np.arange(len(part)), len(some))
                            else:
                                row, q = np.nonzero(_near(metric, some, part) >= least - 1e-9)
                                exact = _exact(metrics, some[row], part[q])
                                kept = exact[0] >= least
                                row, q, exact = row[kept], q[kept], [x[kept] for x in exact]
                            yield pa.RecordBatch.from_arrays([arrow.take(pa.array(mine[q + lo])), pa.array(ids[a + row]), pa.array(exact[0]), pa.array([value] * len(row), scope_kind), *map(pa.array, exact[1:])], names=schema.names)
                        continue
                    if not len(ids):
                        continue
                    near = _near(metric, matrix, part)
                    near[np.isnan(near)] = -np.inf
                    slack = 1e-9 * max(1.0, float(np.abs(near, where=np.isfinite(near), out=np.zeros_like(near)).max()))
                    floor, at = floors.setdefault(value, np.full(len(names), -np.inf)), mine[lo : lo + PART]
                    # all that come near the k-th, as the product differs from the measure in the last digits, and equals come by id
                    asking = np.flatnonzero((near.max(axis=0) >= floor[at] - slack) & (near.max(axis=0) > -np.inf))
                    near = near[:, asking]
                    limit = np.maximum(np.partition(near, -min(len(ids), k), axis=0)[-min(len(ids), k)], floor[at[asking]])
                    close = (near >= limit - slack) & (near > -np.inf)
                    for j, q in enumerate(asking):
                        row = np.flatnonzero(close[:, j])
                        (exact,) = _exact(metrics, matrix[row], np.broadcast_to(part[q], (len(row), size)))
                        old = best.get((int(mine[lo + q]), value))
                        found = (exact, ids[row]) if old is None else (np.r_[old[0], exact], np.r_[old[1], ids[row]])
                        order = np.lexsort((found[1], -found[0] if metric == "cosine" else found[0]))[:k]
                        best[int(mine[lo + q]), value] = [found[0][order], found[1][order]]
                        if len(order) == k:
                            last = found[0][order[-1]]
                            floor[at[q]] = last if metric == "cosine" else -last if metric == "ip" else -last * last
            if best:
                n = [len(v[0]) for v in best.values()]
                groups = [value for (_, value), m in zip(best, n, strict=True) for _ in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [arrow.take(pa.array(np.repeat([q for q, _ in best], n))), pa.array(np.concatenate([v[1] for v in best.values()])), pa.array(np.concatenate([v[0] for v in best.values()])), pa.array(groups, scope_kind)],
                    names=schema.names,
                )
            trim()

        found = rows.mapInArrow(score, schema)
        return found if group and not own else found.drop(schema.names[3])

    blocks = max(1, -(-asked.count() // most_queries))
    place = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, (ask(asked.where(place == i) if blocks > 1 else asked) for i in range(blocks)))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "qid", query_vec: str = "qvec", id_col: str = "vec_id", vec_col: str = "embedding", most_queries: int = BLOCK, group: str | None = None, own: bool = False) -> DataFrame:
    """The exact k nearest rows of corpus for each query, ties by id: (query_id, id_col, score[, group], rank).

    group: a column of the corpus; the k nearest of each of its values. own: the
    queries have it too, or an array of its values, and only rows of a query's
    own values count.
    metric: cosine, l2 or ip (negated inner product). Ids of the corpus are
    integers. Each task keeps k rows a query, so that what is shuffled and
    ranked doesn't grow with the rows.
    """
    found = _scored(queries, corpus, metric, query_id, query_vec, id_col, vec_col, most_queries, k=k, group=group, own=own)
    order = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    keys = [query_id, group] if group and not own else [query_id]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col(id_col)))).where(F.col("rank") <= k)


def similar(queries: DataFrame, corpus: DataFrame, least: float, query_id: str = "qid", query_vec: str = "qvec", id_col: str = "vec_id", vec_col: str = "embedding", most_queries: int = BLOCK) -> DataFrame:
    """All rows of corpus of at least that cosine with each query, (query_id, id_col, score)."""
    return _scored(queries, corpus, "cosine", query_id, query_vec, id_col, vec_col, most_queries, least=least)


def scores(queries: DataFrame, corpus: DataFrame, metric: str = "cosine", query_id: str = "qid", query_vec: str = "qvec", id_col: str = "vec_id", vec_col: str = "embedding", most_queries: int = BLOCK, group: str | None = None, also: str | None = None) -> DataFrame:
    """The measure of every row of corpus with each of a stated set of queries, (query_id, id_col, score[, group][, also]).

    also: a second measure of the same pairs, taken in the same pass, in a column of its name.
    """
    return _scored(queries, corpus, metric, query_id, query_vec, id_col, vec_col, most_queries, group=group, also=also)
