"""Removal of long byte strings that occur more than once, by the order of all suffixes.

The distributed difference-cover algorithm for the cover {1, 2} modulo 3, cut
at the length that counts: sampled suffixes (those at positions 1 and 2 modulo
3) get names, the ranks of their triples of bytes, and then of triples of names,
which stand for three times as many bytes; the last names stand for two bytes
less than the length. The remaining suffixes are merged with the sampled ones:
any two have a shift below three at which both are sampled. Neighbours in the
merged order whose prefixes of the full length are equal repeat. Everything is
decided by ranks and bytes, nothing by hashes.

Every suffix is a row of some fifty bytes on each level, so that the work is a
large multiple of the corpus; README has the figures. remove_repeated_bytes
gives the same result with rows for the suffixes that can reach the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.session import materialize, ship

#: Bytes of the first names.
TRIPLE = 3


def _suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(doc, p, first, head, b0, b1, c0, c1, d0, d1): of every suffix of at least length bytes its first three and eight
    bytes as numbers, its first two bytes, those at length - 4 and - 3, and its last two of the length. Bytes are counted from 1; doc numbers the rows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                n = len(text or b"")
                if n < length:
                    continue
                # a window behind the last suffix is filled with zeros, which stand for no byte
                x = np.r_[np.frombuffer(text, np.uint8).astype(np.int64) + 1, np.zeros(length + 8, np.int64)]
                for lo in range(0, n, 1 << 16):
                    p = np.arange(lo, min(n, lo + (1 << 16)))
                    head = np.zeros(len(p), np.int64)
                    for k in range(6):
                        head = head << 9 | x[p + k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p), doc)), *(pa.array(c) for c in (p, head >> 27, head, x[p], x[p + 1], x[p + length - 4], x[p + length - 3], x[p + length - 2], x[p + length - 1]))],
                        names=["doc", "p", "first", "head", "b0", "b1", "c0", "c1", "d0", "d1"],
                    )

    return docs.mapInArrow(explode, "doc long, p long, first long, head long, b0 long, b1 long, c0 long, c1 long, d0 long, d1 long")


def _named(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with the rank of their columns by, from 1: different values are dealt in ranges, sorted and numbered."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*by).distinct().repartitionByRange(parts, *by).sortWithinPartitions(*by)
    keys = materialize(keys.withColumn("at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("at", 33)
    sizes = sorted((r.part, r.n) for r in keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    base = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0), F.lit(0))
    numbered = keys.select(*by, (base[part] + (F.col("at").bitwiseAND(F.lit((1 << 33) - 1))) + 1).cast("long").alias(name))
    return rows.join(numbered, by)


def _ahead(rows: DataFrame, names: DataFrame, shift: int, out: str) -> DataFrame:
    """rows with the name of the suffix shift further on, 0 behind the end."""
    moved = names.select("doc", (F.col("p") - shift).alias("p"), F.col("name").alias(out))
    return rows.join(moved, ["doc", "p"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """(doc, p): where a string of length bytes starts that starts elsewhere too. docs: doc long, text string; length is 9 at least."""
    ship(docs.sparkSession)
    if length < 9:
        raise ValueError("length is 9 at least")
    every = materialize(_suffixes(docs.select("doc", "text"), length), "suffixes")
    sampled = every.where("p % 3 <> 0")
    names = materialize(_named(sampled.select("doc", "p", "first"), ["first"], "name").select("doc", "p", "name"), "level")
    depth, wanted = TRIPLE, length - 2
    while 3 * depth <= wanted:
        triples = _ahead(_ahead(names.withColumnRenamed("name", "x"), names, depth, "y"), names, 2 * depth, "z")
        names = materialize(_named(triples, ["x", "y", "z"], "name").select("doc", "p", "name"), "level")
        depth *= 3
    # the last step overlaps: names at places that are sampled too reach to within two bytes of what is wanted
    places = [k * depth for k in range(wanted // depth)] + [(wanted - depth) // 3 * 3]
    last = names.withColumnRenamed("name", "n0")
    for i, shift in enumerate(places[1:], 1):
        last = _ahead(last, names, shift, f"n{i}")
    last = last.join(sampled.select("doc", "p", "c0", "c1"), ["doc", "p"])
    by = [f"n{i}" for i in range(len(places))]
    rest = wanted - (places[-1] + depth)
    by += {0: [], 1: ["c1"], 2: ["c0", "c1"]}[rest]
    names = materialize(_named(last, by, "name").select("doc", "p", "name"), "level")
    # each suffix with the names at its sampled shifts; those that are too short to repeat lie behind the end of their document
    rows = every.select("doc", "p", "head", "b0", "b1", "d0", "d1")
    for shift in range(3):
        rows = _ahead(rows, names, shift, f"f{shift}")
    rows = rows.where("d1 > 0").withColumn("c", (F.col("p") % 3).cast("int"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # suffixes that share six bytes are merged together
    return rows.repartitionByRange(parts, "head").sortWithinPartitions("head").mapInArrow(_merged, "doc long, p long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts each run of suffixes with equal heads and yields those equal to a neighbour."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
    if not held:
        return
    table = pa.Table.from_batches(held)
    v = {n: table[n].to_numpy() for n in table.column_names}
    cuts = np.flatnonzero(np.diff(v["head"])) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(v["head"])], strict=True):
        if b - a > 1:
            run = {n: x[a:b] for n, x in v.items()}
            hit = merge(run)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(run["doc"][hit]), pa.array(run["p"][hit])], names=["doc", "p"])


def merge(v: dict[str, np.ndarray]) -> np.ndarray:
    """Which of the suffixes equal a neighbour in their order, over the full length.

    Those at 1 and 2 modulo 3 are ordered by their own names; those at 0 by a
    byte and the name behind it, which the first kind has too, and find their
    places among the second kind by two bytes and the name behind these.
    """
    sample, rest = np.flatnonzero(v["c"] != 0), np.flatnonzero(v["c"] == 0)
    sample = sample[np.lexsort((v["d1"][sample], v["d0"][sample], v["f0"][sample]))]
    rest = rest[np.lexsort((v["d1"][rest], v["f1"][rest], v["b0"][rest]))]
    one = lambda i: v["b0"][i] << 53 | v["f1"][i] << 9 | v["d1"][i]  # noqa: E731  a byte, the name from the next on, the last byte
    two = lambda i: v["b0"][i] << 53 | v["b1"][i] << 44 | v["f2"][i]  # noqa: E731  two bytes, the name behind them
    before = np.zeros(len(rest), np.int64)
    for kind, key in ((1, one), (2, two)):
        own = sample[v["c"][sample] == kind]
        before += np.searchsorted(key(own), key(rest), "left")
    order = np.empty(len(sample) + len(rest), np.int64)
    place = before + np.arange(len(rest))
    order[place] = rest
    free = np.ones(len(order), bool)
    free[place] = False
    order[free] = sample
    x, y = order[:-1], order[1:]
    kinds = v["c"][x] * 3 + v["c"][y]
    same = np.where(np.isin(kinds, (0, 1, 3)), one(x) == one(y), two(x) == two(y))
    both = np.isin(kinds, (4, 5, 7, 8))
    same = np.where(both, (v["f0"][x] == v["f0"][y]) & (v["d0"][x] == v["d0"][y]) & (v["d1"][x] == v["d1"][y]), same)
    out = np.zeros(len(order), bool)
    out[x[same]] = out[y[same]] = True
    return out


def spans(starts: Column, length: int) -> Column:
    """Sorted starts as runs (start, end) that the strings cover."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.concat(acc, F.array(F.struct(p.alias("start"), (p + length).alias("end"))))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), (p + length).alias("end"))))
        return F.when((F.size(acc) > 0) & (p <= F.try_element_at(acc, F.lit(-1))["end"]), longer).otherwise(fresh)

    return F.aggregate(starts, zero, step)
