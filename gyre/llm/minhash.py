"""Near-duplicate documents: fast similarity sketches, bands, exact checks, components.

A sketch has t coordinates. In round i every element of a document's shingle
set is thrown into a bin by a hash of the round; a bin keeps the smallest
(round, hash). Later rounds never replace an earlier one's value, so that they
only concern sets with empty bins, and rounds t to 2t-1 throw all elements into
bin i-t: every coordinate is filled. Two sets agree in a coordinate with the
probability of their similarity, with the concentration of independent draws.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.components import components
from gyre.llm.names import mix
from gyre.llm.words import forget, word_hashes
from gyre.session import materialize, ship, sized, trim

#: 40 bands of 6: two sets of similarity 0.8 share no band once in 190,000 pairs, and of 0.9 never in practice.
BANDS, ROWS = 40, 6
#: Members of a bucket that are compared at once, and bytes of their elements.
BLOCK, BLOCK_BYTES = 2048, 8 << 20

_ROUND = np.uint64(54)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of the whole sequence if there are fewer words."""
    words = word_hashes(text.lower())
    n = len(words)
    if n == 0:
        return words
    span = min(size, n)
    x = mix(words[: n - span + 1] + np.uint64(span))
    for k in range(1, span):
        x = mix(x ^ (words[k : n - span + 1 + k] * np.uint64(2 * k + 1)))
    x.sort()
    return x[np.r_[True, x[1:] != x[:-1]]]


def sketches(elements: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """n x t sketches of the sets whose elements are given with the number of their set. Every set has an element."""
    out = np.full(n * t, _EMPTY)
    for i in range(2 * t):
        seed = np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = mix(elements ^ seed)
        slot = (h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if i < t else np.uint64(i - t)
        value = np.uint64(i) << _ROUND | mix(h) >> np.uint64(10)
        np.minimum.at(out, owner * t + slot.astype(np.int64), value)
        open_sets = (out.reshape(n, t) == _EMPTY).any(axis=1)
        if not open_sets.any():
            break
        live = open_sets[owner]
        elements, owner = elements[live], owner[live]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes, different between bands."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.ones((len(sketch), 1), np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(3) + parts[:, :, k])
    return key.view(np.int64)


def batches_of_text(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows of about most bytes of text."""
    texts = [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
    lo, held = 0, 0
    for hi, t in enumerate(texts, 1):
        held += len(t)
        if held >= most or hi == len(texts):
            yield lo, hi, texts[lo:hi]
            lo, held = hi, 0


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """For each row of docs its id, n_shingles, component_id and kept.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    word shingles (A-Z lower-cased, words between ASCII white space, the whole
    sequence if it is shorter than a shingle). component_id is the smallest id
    that links reach, kept says that it is the document's own.

    Null and empty texts have an empty set and link with nothing. Rows that
    share an id count as one document. A row without an id takes part under
    no name: it links with nothing, has no component_id and is kept. Repeated
    rows have the same result. An empty table gives no rows.

    Equal sets form a class at once; a class is sketched for its smallest id.
    Candidates are first each bucket's members with its smallest. When these
    links are contracted, buckets that still hold different components are
    screened in blocks of members, which yield only pairs that pass, so that no
    pair of a bucket goes unchecked unless both are linked already. All links
    are confirmed on the full sets. Ids are integers.
    """
    ship(docs.sparkSession)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    t = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in batches_of_text(batch, 1):
                sets = [shingle_set(x, shingle) for x in texts]
                sizes = np.array([len(x) for x in sets])
                full = np.flatnonzero(sizes)
                sums = [None] * len(sets)
                keys = [None] * len(sets)
                if len(full):
                    elements = np.concatenate([sets[i] for i in full])
                    found = band_keys(sketches(elements, np.repeat(np.arange(len(full)), sizes[full]), len(full), t), bands, rows)
                    starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
                    # 128 bits for a set: sums of two independent hashes of its elements, with their number
                    a = np.add.reduceat(mix(elements), starts)
                    b = np.add.reduceat(mix(elements * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), starts)
                    for j, i in enumerate(full):
                        sums[i] = a[j].tobytes() + b[j].tobytes() + sizes[i].tobytes()
                        keys[i] = found[j]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(sums, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "class", "keys"],
                )
        forget()

    sketched = materialize(docs.select(key.cast("long").alias("id"), text.alias("text")).mapInArrow(sketch, "id long, n_shingles long, class binary, keys array<long>"), "sketches")
    named = sketched.where("id is not null and n_shingles > 0")
    # one row for a class of equal sets; all its rows have the same keys
    classes = materialize(named.groupBy("class").agg(F.min("id").alias("node"), F.count("*").alias("n")), "classes")
    nodes = named.join(classes.select("class", F.col("node").alias("id")).hint("shuffle_merge"), ["class", "id"]).dropDuplicates(["id", "class"])
    banded = materialize(nodes.select(F.col("id").alias("node"), F.explode("keys").alias("key")), "bands")
    buckets = banded.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    full = materialize(banded.join(buckets, "key"), "buckets")
    stars = full.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()

    texts = docs.select(key.cast("long").alias("id"), text.alias("text"))
    links = materialize(confirmed(texts, stars, shingle, percent), "links")
    found = materialize(components(links), "components")
    # what buckets hold beyond: members of different components, none of which the stars have shown
    label = F.coalesce("component", "node")
    labelled = full.join(found, "node", "left").select("key", "node", label.alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    left = materialize(labelled.join(mixed, "key"), "mixed")
    concerned = materialize(left.select(F.col("node").alias("id")).distinct(), "concerned")
    held = texts.join(sized(concerned), "id", "left_semi").mapInArrow(_sets(shingle, packed=True), "id long, elements binary").dropDuplicates(["id", "elements"])
    rest = _screened(left, materialize(held, "held"), percent)
    more = materialize(confirmed(texts, rest, shingle, percent), "more")
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "components")
    of_class = classes.join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    out = sketched.join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def confirmed(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets are similar enough, on sets made anew from the texts (id, text) of those concerned."""
    pairs = materialize(pairs, "pairs")
    concerned = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "concerned")
    members = texts.join(sized(concerned), "id", "left_semi")
    sets = materialize(members.mapInArrow(_sets(shingle), "id long, elements array<long>").dropDuplicates(["id", "elements"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
    return both.mapInArrow(_similar(percent), "a long, b long").distinct()


def _screened(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of one bucket (key) in different parts whose sets are similar enough.

    A bucket of over BLOCK members, or of over BLOCK_BYTES of elements, is dealt
    in blocks, each pair of blocks to a group of its own.
    """
    lengths = sets.groupBy(F.col("id").alias("node")).agg(F.sum(F.length("elements")).alias("bytes"))
    enough = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES))
    sizes = materialize(left.join(lengths, "node").groupBy("key").agg(enough.cast("int").alias("blocks"), F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "sizes")
    total = sizes.agg(F.sum(F.col("n") * F.col("blocks")), F.sum(F.col("bytes") * F.col("blocks"))).first()
    groups = max(1, (total[0] or 0) // 2000, (total[1] or 0) // BLOCK_BYTES)
    rows = left.join(sizes.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    rows = materialize(rows.select("key", "node", "part", "block", F.explode(others).alias("pair")).select("key", "node", "part", "block", "pair.i", "pair.j"), "blocks")
    rows = rows.join(sets.select(F.col("id").alias("node"), "elements"), "node")
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))

    def screen(table: pa.Table) -> pa.Table:
        key = np.array([table[c].to_numpy() for c in ("key", "i", "j")])
        order = np.lexsort(key[::-1])
        cut = np.flatnonzero((np.diff(key[:, order]) != 0).any(axis=0)) + 1
        node, part, block = (table[c].to_numpy() for c in ("node", "part", "block"))
        elements = table["elements"].combine_chunks()
        pairs = set()
        for rows_ in np.split(order, cut):
            own = [np.frombuffer(elements[int(r)].as_buffer(), np.uint64) for r in rows_]
            crossed = block[rows_] if key[1, rows_[0]] != key[2, rows_[0]] else None
            for p, q in _passing(own, part[rows_], crossed, percent):
                a, b = node[rows_[p]], node[rows_[q]]
                if a != b:
                    pairs.add((min(a, b), max(a, b)))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        del elements, table
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("group").applyInArrow(screen, "a long, b long").distinct()


def _passing(sets: list[np.ndarray], part: np.ndarray, crossed: np.ndarray | None, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets in different parts (and blocks, if crossed gives them) that are similar enough."""
    n = np.array([len(x) for x in sets])
    if len(sets) <= 24:
        for p in range(len(sets)):
            for q in range(p + 1, len(sets)):
                if part[p] != part[q] and (crossed is None or crossed[p] != crossed[q]) and 100 * min(n[p], n[q]) >= percent * max(n[p], n[q]):
                    both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                    if 100 * both >= percent * (n[p] + n[q] - both):
                        yield p, q
        return
    # overlaps of all as a product of membership matrices, a range of elements at a time
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.r_[False, every[1:] != every[:-1]])
    often = np.bincount(number)[number] > 1
    number, owner = np.unique(number[often], return_inverse=True)[1], owner[often]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        a, b = np.searchsorted(number, (lo, lo + 2048))
        inside = np.zeros((len(sets), 2048), np.float32)
        inside[owner[a:b], number[a:b] - lo] = 1
        both += inside @ inside.T
    passed = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    passed &= part[:, None] != part[None, :]
    if crossed is not None:
        passed &= crossed[:, None] != crossed[None, :]
    for p, q in np.argwhere(np.triu(passed, 1)):
        yield int(p), int(q)


def _sets(shingle: int, packed: bool = False):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in batches_of_text(batch, 1, 1 << 20):
                sets = [shingle_set(x, shingle) for x in texts]
                made = pa.array([x.tobytes() for x in sets], pa.binary()) if packed else pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), made], names=["id", "elements"])
        forget()

    return make


def _similar(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                p, q = (c.values.to_numpy(zero_copy_only=False)[c.offsets[i].as_py() : c.offsets[i + 1].as_py()] for c in (x, y))
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep[i] = both > 0 and 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
        trim()

    return check


