"""Packing of documents into fixed-length sequences by a grouping genetic algorithm.

Pieces of equal length can stand for each other, so that a packing problem is
the number of pieces of each length, of which there are at most as many as
tokens in a sequence, whatever the size of the corpus. A solution is a list of
bins by content with their multiplicity. Islands evolve solutions as Spark
tasks; after each epoch the best of all islands migrate to all of them. Pieces
then get their places by rank within their length, without a global sort.
"""

from __future__ import annotations

import pickle
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.tokens import Encoder
from gyre.session import materialize, ship, sized, trim

Bins = dict[tuple[int, ...], int]
EOS = 2
#: Places that bins made of displaced pieces may leave free.
SPARE = (0, 0, 1, 2, 4, 8, 16)
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else the remainder first and full pieces after it."""
    full, rest = divmod(n, capacity)
    out = [(0, rest)] if rest else []
    return out + [(rest + i * capacity, capacity) for i in range(full)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, four bytes each) of each document's ids and a final EOS. A null text is empty.

    _task and _place number the pieces of a length: the task that made them and
    the place among those of its making. They hold once the rows are written.
    """
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")),
        *([T.StructField("ids", T.BinaryType())] if with_ids else []), T.StructField("_task", T.LongType()), T.StructField("_place", T.LongType()),
    ])
    end = EOS.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, made = _encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            held = 0
            for i, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, x in zip(rows, (i, k, start, length, zlib.crc32(part), part if with_ids else None, made[length]), strict=True):
                        column.append(x)
                    made[length] += 1
                    held += len(part) if with_ids else 0
                if held > 8 << 20:
                    yield _piece_batch(batch, rows, schema, with_ids, task)
                    rows, held = [[] for _ in range(7)], 0
            yield _piece_batch(batch, rows, schema, with_ids, task)
        trim()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(encode, schema)


def _piece_batch(batch: pa.RecordBatch, rows: list[list], schema: T.StructType, with_ids: bool, task: int) -> pa.RecordBatch:
    columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
    ids = [pa.array(rows[5], pa.binary())] if with_ids else []
    return pa.RecordBatch.from_arrays([*columns, *ids, pa.array([task] * len(rows[0]), pa.int64()), pa.array(rows[6], pa.int64())], names=schema.names)


# --- the genetic algorithm, on counts by length


def used(bins: Bins) -> Counter:
    out: Counter = Counter()
    for content, n in bins.items():
        for length, k in Counter(content).items():
            out[length] += k * n
    return out


def best_fit(bins: Bins, counts: Counter, capacity: int) -> Bins:
    """bins with the pieces of counts added, largest first, each to the fullest bin that takes it, else to a new one.

    Bins of equal content are handled together, so that the work depends on the
    number of lengths and not on that of pieces.
    """
    room: dict[int, Bins] = {}
    order: list[int] = []

    def put(content: tuple[int, ...], n: int) -> None:
        left = capacity - sum(content)
        if left not in room:
            room[left] = {}
            insort(order, left)
        room[left][content] = room[left].get(content, 0) + n

    for content, n in bins.items():
        put(content, n)
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            left = order[at]
            content, held = next(iter(room[left].items()))
            each = min(left // length, n)
            moved = min(held, n // each)
            n -= moved * each
            if moved == held:
                del room[left][content]
                if not room[left]:
                    del room[left], order[at]
            else:
                room[left][content] -= moved
            put(content + (length,) * each, moved)
    out: Bins = {}
    for group in room.values():
        for content, n in group.items():
            content = tuple(sorted(content, reverse=True))
            out[content] = out.get(content, 0) + n
    return out


def filled(counts: Counter, capacity: int, spare: int = 0) -> Bins:
    """Bins for the pieces of counts, each begun with the largest piece left and
    filled as far as any choice of the others allows, up to spare places less if
    larger pieces make that, so that short ones last longer.

    A choice is taken as often as its pieces last, which uses a length up: the
    work depends on the number of lengths alone.
    """
    left, out = {x: n for x, n in sorted(counts.items()) if n > 0}, {}
    mask = (1 << (capacity + 1)) - 1
    while left:
        lengths = list(left)
        first = lengths[-1]
        # the sums, as bits, that the pieces of the i shortest lengths can make
        sums = [1]
        for x in lengths:
            bits, n, step = sums[-1], min(left[x] - (x == first), capacity // x), 1
            while n > 0:
                k = min(step, n)
                bits |= bits << (k * x) & mask
                n, step = n - k, step * 2
            sums.append(bits)
        high = (sums[-1] & ((1 << (capacity - first + 1)) - 1)).bit_length() - 1
        low = max(0, high - spare)
        content = [first]
        for i in range(len(lengths) - 1, -1, -1):
            if not low:
                break
            x = lengths[i]
            k = min(left[x] - (x == first), high // x)
            # the others must reach a sum from low to high
            while not sums[i] >> max(0, low - k * x) & ((1 << (high - k * x - max(0, low - k * x) + 1)) - 1):
                k -= 1
            content += [x] * k
            low, high = max(0, low - k * x), high - k * x
        need = Counter(content)
        times = min(left[x] // k for x, k in need.items())
        out[tuple(content)] = out.get(tuple(content), 0) + times
        for x, k in need.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def least_bins(counts: Counter, capacity: int) -> int:
    """A number of bins that no packing goes below (Martello and Toth): pieces of over half a bin need one each, and what smaller ones don't find beside them needs others."""
    n, tokens = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    for x, k in counts.items():
        n[x] = k
    many, long = np.cumsum(n), np.cumsum(n * tokens)
    half, best = capacity // 2, 0
    for k in range(half + 1):
        # alone: over capacity - k; beside smaller ones: the others of over half
        alone, beside = many[capacity] - many[capacity - k], many[capacity - k] - many[half]
        room = beside * capacity - (long[capacity - k] - long[half])
        small = long[half] - (long[k - 1] if k else 0)
        best = max(best, int(alone + beside + max(0, -(-(small - room) // capacity))))
    return best


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then a less even fill: the smaller the better."""
    return sum(bins.values()), -sum(n * (sum(c) / capacity) ** 2 for c, n in bins.items())


def crossover(a: Bins, b: Bins, counts: Counter, capacity: int, r: random.Random) -> Bins:
    """Whole well-filled bins of a are injected into b; b's bins that hold the
    same pieces go, and their other pieces, displaced, are fitted anew."""
    child: Bins = {}
    left = Counter(counts)
    full = sorted(a, key=lambda c: (-sum(c), r.random()))
    for content in full[: max(1, int(len(full) * r.uniform(0.1, 0.6)))]:
        n = a[content] if r.random() < 0.7 else r.randint(1, a[content])
        child[content] = n
        for length, k in Counter(content).items():
            left[length] -= k * n
    # b's bins as far as their pieces are still there: the rest would be duplicates
    for content in sorted(b, key=lambda c: (-sum(c), r.random())):
        need = Counter(content)
        n = min(b[content], min(left[length] // k for length, k in need.items()))
        if n > 0:
            child[content] = child.get(content, 0) + n
            for length, k in need.items():
                left[length] -= k * n
    return refitted(mutated(child, left, capacity, r), left, capacity, r)


def mutated(bins: Bins, left: Counter, capacity: int, r: random.Random) -> Bins:
    """bins without the worst filled and a share of the others, whose pieces go to left: these can be combined anew."""
    out = dict(bins)
    order = sorted(out, key=lambda c: (sum(c), r.random()))
    opened = {*order[: r.randint(1, 8)], *(c for c in order if sum(c) < capacity and r.random() < 0.8), *r.sample(order, int(len(order) * r.uniform(0.02, 0.3)))}
    for content in sorted(opened):
        n = out.pop(content)
        for length, k in Counter(content).items():
            left[length] += k * n
    return out


def refitted(bins: Bins, left: Counter, capacity: int, r: random.Random) -> Bins:
    """bins and the displaced pieces: these make well-filled bins among themselves, and of what is over each goes where it fits best."""
    spare = r.choice(SPARE)
    whole, over = {}, Counter()
    for content, n in filled(left, capacity, spare).items():
        if sum(content) >= capacity - spare:
            whole[content] = n
        else:
            for length, k in Counter(content).items():
                over[length] += k * n
    for content, n in bins.items():
        whole[content] = whole.get(content, 0) + n
    return best_fit(whole, over, capacity)


def evolve(counts: Counter, capacity: int, elite: list[Bins], seed: int, population: int = 6, generations: int = 8) -> list[Bins]:
    """The two best solutions of an island after some generations; it stops early where no packing can be better."""
    r = random.Random(seed)
    least = least_bins(counts, capacity)
    rank = lambda bins: fitness(bins, capacity)
    group = list(elite) or [best_fit({}, counts, capacity)]
    while len(group) < population // 2:
        group.append(refitted({}, Counter(counts), capacity, r))
    while len(group) < population:
        # other starts: some pieces fitted first
        some = Counter({k: r.randint(0, n) for k, n in counts.items()})
        group.append(best_fit(best_fit({}, some, capacity), counts - some, capacity))
    for _ in range(generations):
        group.sort(key=rank)
        if rank(group[0])[0] <= least:
            break
        pick = lambda: min(r.sample(group, 2), key=rank)
        group = group[:2] + [crossover(pick(), pick(), counts, capacity, r) for _ in range(population - 2)]
    return sorted(group, key=rank)[:2]


def solve(spark: SparkSession, counts: Counter, capacity: int, islands: int = 4, epochs: int = 2) -> Bins:
    """The best solution of all islands. What travels is bounded by the number of lengths, not of pieces."""
    ship(spark)
    least = least_bins(counts, capacity)
    elite: list[Bins] = []
    for epoch in range(epochs):
        sent = pickle.dumps((counts, elite))

        def island(batches, sent=sent, epoch=epoch):
            given, best = pickle.loads(sent)
            for pdf in batches:
                for i in pdf["id"]:
                    found = evolve(given, capacity, best, seed=1000 * epoch + int(i))
                    yield type(pdf)({"id": [int(i)] * len(found), "solution": [pickle.dumps(x) for x in found]})

        rows = spark.range(0, islands, 1, islands).mapInPandas(island, "id long, solution binary").collect()
        elite = sorted((pickle.loads(x.solution) for x in rows), key=lambda b: (fitness(b, capacity), sorted(b.items())))[:2]
        if sum(elite[0].values()) <= least:
            break
    return elite[0]


def places(bins: Bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, sequence, offset of each run of places: pieces of a length with the ranks from key & (2^44-1) on lie in consecutive sequences at that offset."""
    rows, base, taken = [], 0, Counter()
    for content in sorted(bins):
        at = 0
        for length in content:
            rows.append((length << 44 | taken[length], base, at))
            taken[length] += bins[content]
            at += length
        base += bins[content]
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, islands: int = 4, epochs: int = 2
) -> DataFrame:
    """The pieces of all documents with sequence_id and offset.

    A document is its ids with a final EOS; only longer ones than capacity are
    cut, with the shorter piece first. Pieces in a sequence follow each other
    without gaps from 0. A null or empty text is the EOS alone; repeated rows
    and rows without an id are pieces of their own; an empty table gives no rows.
    docs' other columns are not carried along.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces")
    counts = Counter({x.length: x.n for x in made.groupBy("length").agg(F.count("*").alias("n")).collect()})  # capacity rows at most
    bins = solve(spark, counts, capacity, islands, epochs)
    # a piece's rank within its length: those of earlier tasks, and its place in its own
    sizes = made.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(sizes.select("length", "_task", F.coalesce(before, F.lit(0)).alias("_before")), "sizes")
    names = [c for c in made.columns if c not in ("_task", "_place")]
    ranked = made.join(sized(sizes), ["length", "_task"]).select(*[f"`{c}`" for c in names], (F.col("_place") + F.col("_before")).alias("_rank"))
    key, sequence, offset = places(bins)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("length").to_numpy() << 44 | batch.column("_rank").to_numpy()
            at = np.searchsorted(key, wanted, "right") - 1
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + wanted - key[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*(f for f in made.schema.fields if f.name in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
