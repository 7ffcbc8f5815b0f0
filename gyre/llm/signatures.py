"""Jaccard join of documents on their word shingles by signature trees.

Hierarchy. A pair that is similar enough differs in few elements: for sizes a
and b in (100 - p) / (100 + p) * (a + b) at most. The upper levels of the
hierarchy are therefore ranges of sizes and, in each, equal parts: elements
are thrown into one part more than a pair of these sizes may differ in, so that
at least one part of a pair is the same. Below an equal part stands a tree:
its leaves are documents with a bitmap of their elements, their size and their
excess (elements beyond one a bit); its nodes combine the bitmaps by OR and
have ranges of sizes and the largest excess. What two documents under two nodes
can share is at most the bits both nodes have and the smaller excess; two trees
are traversed together, and pairs of nodes go that can't share enough.

No pair of sets that is similar enough is lost but by chances like that of
equal 64-bit hashes: of two lists of members that agree in size, ends and 96
bits of hashes one is searched, and of over NAMED parts the first NAMED are
named, all of which differ in a similar pair less than once in 2^63. Equal
hashes of different parts only add candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.components import components
from gyre.llm.minhash import batches_of_text, confirmed, shingle_set
from gyre.llm.names import mix
from gyre.llm.words import forget
from gyre.session import materialize, ship, sized, trim

#: Parts of a scheme that are named at most. A pair that may differ in k elements has each of k + 1 parts equal with a chance of over 1/e:
#: that all of so many differ has a chance below 2^-63, that of two equal hashes. Sets with no more parts name all.
NAMED = 96
#: Independent ways to throw elements into parts; a document goes on to the next only while one of its parts is empty.
VARIANTS = 8
#: Members of a part that one tree holds, bytes of their bitmaps, children of a node, pairs of nodes that are looked at together.
BLOCK, BLOCK_BYTES, FAN, STEP = 2048, 16 << 20, 8, 4096
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scheme:
    """A range of sizes: those of the smaller document of a pair, and what follows from them."""

    low: int
    top: int
    #: the largest partner, the parts that a pair can't differ in all of, the bits of a bitmap
    reach: int
    parts: int
    bits: int


@cache
def schemes(percent: int) -> tuple[Scheme, ...]:
    out, low = [], 1
    while low < 1 << 40:
        top = max(low + 1, low * 3 // 2) - 1
        reach = top * 100 // percent
        parts = (100 - percent) * (top + reach) // (100 + percent) + 1
        out.append(Scheme(low, top, reach, parts, max(64, 1 << (4 * reach - 1).bit_length())))
        low = top + 1
    return tuple(out)


@cache
def _of_size(n: int, percent: int) -> tuple[int, ...]:
    return tuple(i for i, s in enumerate(schemes(percent)) if s.low <= n <= s.reach)


@cache
def _edges(parts: int) -> np.ndarray:
    """The ends of the parts that are named, as hashes; of the last part, if it is among them, that is the end of all."""
    return np.array([-(-(j << 64) // parts) for j in range(1, min(NAMED + 1, parts))], dtype=np.uint64)


def part_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Names of the parts of a set, of all schemes that its size belongs to; the scheme is in the lowest byte.

    A pair that is similar enough has an equal part in each variant. Only
    where that part is empty in both does the variant not show it; then both
    go on to the next. The last one names empty parts as well.
    """
    out = []
    for i in _of_size(len(elements), percent):
        parts = schemes(percent)[i].parts
        if parts == 1:
            continue  # only equal sets are similar enough
        for variant in range(VARIANTS):
            x = np.sort(mix(elements + np.uint64((variant + 1) * int(_K) & 0xFFFFFFFFFFFFFFFF)))
            ends = np.r_[0, np.searchsorted(x, _edges(parts)), len(x)][: NAMED + 1]
            total = np.r_[np.uint64(0), np.cumsum(mix(x + _K))]
            own = total[ends[1:]] - total[ends[:-1]]
            place = np.arange(len(own), dtype=np.uint64) * np.uint64(VARIANTS) + np.uint64(variant)
            name = mix(own ^ mix(place * _K + np.uint64(i))) & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(i)
            filled = np.diff(ends) > 0
            out.append(name if variant == VARIANTS - 1 else name[filled])
            if filled.all():
                break
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def bitmap(elements: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of so many bits (a power of two), as 64-bit words."""
    bit = mix(elements ^ _K) >> np.uint64(64 - (bits.bit_length() - 1))
    out = np.zeros(bits, np.uint8)
    out[bit.astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


class Tree:
    """Nodes by level, the documents at level 0; a node of the next level stands over FAN of this one."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, part: np.ndarray):
        # alike documents beside each other: by part, then by size and their first bits
        self.order = np.lexsort((bits[:, 0], size, part))
        bits, size, part = bits[self.order], size[self.order], part[self.order]
        excess = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, excess, part, part)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, first, last = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _open(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether documents of different parts under nodes i of level a and j of level b may be similar enough."""
    most = np.minimum(a[2][i], b[2][j])
    least = a[1][i] + b[1][j]
    keep = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    keep &= ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
    excess = np.minimum(a[3][i], b[3][j])
    at = np.flatnonzero(keep)
    step = max(1, (4 << 20) // max(1, a[0].shape[1] * 8))
    for lo in range(0, len(at), step):
        k = at[lo : lo + step]
        shared = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(axis=1, dtype=np.int64)
        keep[k] = np.minimum(most[k], excess[k] + shared) * (100 + percent) >= percent * least[k]
    return keep


def _children(nodes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes, and which node each comes from."""
    first = nodes * FAN
    n = np.minimum(first + FAN, below) - first
    owner = np.repeat(np.arange(len(nodes)), n)
    return np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(owner)), owner


def traverse(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (documents of a, documents of b) in different parts that may be similar enough; with a tree and itself each pair once."""
    self_join = a is b
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        p, q, i, j = todo.pop()
        if len(i) > STEP:
            todo += [(p, q, i[lo : lo + STEP], j[lo : lo + STEP]) for lo in range(0, len(i), STEP)]
            continue
        keep = _open(a.levels[p], b.levels[q], i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if p == q == 0:
            if self_join:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a.order[i], b.order[j]
            continue
        # the higher node opens first; equal ones open together
        down_a, down_b = p >= q, q >= p
        if down_a:
            i, of = _children(i, len(a.levels[p - 1][1]))
            j, p = j[of], p - 1
        if down_b:
            j, of = _children(j, len(b.levels[q - 1][1]))
            i, q = i[of], q - 1
        if self_join:
            i, j = i[i <= j], j[i <= j]
        todo.append((p, q, i, j))


def _leaders(tree: Tree, node: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Documents dealt to leaders, the one with the smallest node of what is left: (leader, others that may be similar enough to it)."""
    rest = np.ones(len(node), bool)
    place = np.argsort(tree.order)
    for lead in np.argsort(node, kind="stable"):
        if not rest[lead]:
            continue
        rest[lead] = False
        leaf, found = np.array([place[lead]]), np.zeros(1, np.int64)
        for level in range(len(tree.levels) - 1, -1, -1):
            if level < len(tree.levels) - 1:
                found, _ = _children(found, len(tree.levels[level][1]))
            found = found[_open(tree.levels[0], tree.levels[level], np.repeat(leaf, len(found)), found, percent)]
        hits = tree.order[found]
        hits = hits[rest[hits]]
        rest[hits] = False
        yield int(lead), hits


def _searched(percent: int, spanning: bool):
    """For groups of (key, node, part, i, j, block, n, bits): candidate pairs of nodes (a, b) within each (key, i, j)."""

    def search(table: pa.Table) -> pa.Table:
        names = np.array([table[c].to_numpy() for c in ("key", "i", "j")])
        order = np.lexsort(names[::-1])
        cut = np.flatnonzero((np.diff(names[:, order]) != 0).any(axis=0)) + 1
        node, part, block, size = (table[c].to_numpy() for c in ("node", "part", "block", "n"))
        packed = table["bits"].combine_chunks()
        flat, starts = np.frombuffer(packed.buffers()[2], np.uint8), np.frombuffer(packed.buffers()[1], np.int32)[packed.offset :]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        twos: dict[int, list[np.ndarray]] = {}
        for rows in np.split(order, cut):
            width = int(starts[rows[0] + 1] - starts[rows[0]])
            if len(rows) == 2:
                twos.setdefault(width, []).append(rows)
                continue
            bits = np.stack([flat[starts[r] : starts[r] + width] for r in rows]).view(np.uint64)
            if names[1, rows[0]] != names[2, rows[0]]:
                sides = [np.flatnonzero(block[rows] == names[c, rows[0]]) for c in (1, 2)]
                if not all(map(len, sides)):
                    continue
                trees = [Tree(bits[s], size[rows[s]], part[rows[s]]) for s in sides]
                if spanning:
                    # only what holds the blocks together: the first block's smallest node meets the other block
                    sides = [sides[0][[node[rows[sides[0]]].argmin()]], sides[1]]
                    trees = [Tree(bits[s], size[rows[s]], part[rows[s]]) for s in sides]
                found += [(node[rows[sides[0][p]]], node[rows[sides[1][q]]]) for p, q in traverse(*trees, percent)]
                continue
            tree = Tree(bits, size[rows], part[rows])
            if spanning:
                found += [(np.repeat(node[rows[p]], len(q)), node[rows[q]]) for p, q in _leaders(tree, node[rows], percent) if len(q)]
            else:
                found += [(node[rows[p]], node[rows[q]]) for p, q in traverse(tree, tree, percent)]
        for width, pairs in twos.items():
            rows = np.array(pairs)
            bits = np.stack([flat[starts[r] : starts[r] + width] for r in rows.ravel()]).view(np.uint64)
            own = size[rows.ravel()]
            level = (bits, own, own, own - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), part[rows.ravel()], part[rows.ravel()])
            i = np.arange(0, len(own), 2)
            rows = rows[_open(level, level, i, i + 1, percent)]
            found.append((node[rows[:, 0]], node[rows[:, 1]]))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        both = np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)][a != b], axis=0)
        trim()
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return search


def _candidates(members: DataFrame, held: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Pairs of nodes in different parts that trees don't rule out; of (key, node, part) and the nodes' bitmaps (node, scheme, n, bits).

    spanning: only so many that they connect what is alike, if bitmaps say so
    rightly. A key with many members is dealt in blocks, pairs of blocks to
    groups of their own; pairs of blocks that hold one part alone have none.
    """
    width = F.element_at(F.array(*[F.lit(float(s.bits // 8)) for s in schemes(percent)]), (F.col("key").bitwiseAND(F.lit(255)) + 1).cast("int"))
    tally = members.groupBy("key", "part").agg(F.count("*").alias("n"))
    # the largest part has blocks of its own, so that most of its pairs of blocks need no look
    sizes = tally.groupBy("key").agg(F.max_by("part", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    each = F.least(F.lit(float(BLOCK)), F.greatest(F.lit(2.0), F.lit(float(BLOCK_BYTES)) / width))
    split = F.col("n") > each
    sizes = sizes.select("key", "main", F.when(split, F.ceil(F.col("most") / each)).otherwise(1).cast("int").alias("of_main"), F.when(split, F.ceil((F.col("n") - F.col("most")) / each)).otherwise(0).cast("int").alias("of_rest"), (F.col("n") * width).alias("bytes"))
    sizes = materialize(sizes.withColumn("blocks", F.col("of_main") + F.col("of_rest")), "sizes")
    total = sizes.agg(F.sum(F.col("bytes") * (2 if spanning else 1) * F.col("blocks"))).first()[0] or 0
    groups = max(1, int(total) // (BLOCK_BYTES // 2))
    rows = members.join(sizes.select("key", "main", "of_main", "of_rest", "blocks"), "key")
    in_main = (F.col("part") == F.col("main")) | (F.col("of_rest") == 0)
    block = F.when(in_main, F.pmod(F.xxhash64("node"), F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(F.xxhash64("node"), F.col("of_rest"))).cast("int")
    rows = rows.withColumn("block", block)
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j")))
    if spanning:
        met = F.filter(met, lambda x: (x["i"] == 0) | (x["i"] == x["j"]))
    else:
        met = F.filter(met, lambda x: (F.col("of_rest") == 0) | (x["j"] >= F.col("of_main")))
    rows = rows.select("key", "node", "part", "block", F.explode(met).alias("x")).select("key", "node", "part", "block", "x.i", "x.j", F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("scheme"))
    dealt = rows.join(held, ["node", "scheme"]).withColumn("group", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_searched(percent, spanning), "a long, b long").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """For each row of docs its id, n_shingles and component_id.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of
    word shingles (A-Z lower-cased, words between ASCII white space, the whole
    sequence if it is shorter than a shingle). component_id is the smallest id
    that links reach, the document's own included.

    Null and empty texts have an empty set and link with nothing. Rows that
    share an id count as one document. A row without an id links with nothing
    and has no component_id. Repeated rows have the same result; other columns
    don't matter. An empty table gives no rows. Ids are integers.

    Equal sets form a class at once. Members of equal parts are searched by
    trees twice: first for pairs with leaders, which connect what is alike;
    then, where a part still holds documents that confirmed links don't
    connect, for all pairs between them. All links are confirmed on full sets.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, run in batches_of_text(batch, 1):
                sets = [shingle_set(x, shingle) for x in run]
                sizes = pa.array([len(x) for x in sets], pa.int64())
                # 128 bits for a set: sums of two independent hashes of its elements, with their number
                sums = [mix(x).sum(dtype=np.uint64).tobytes() + mix(x * _K + np.uint64(1)).sum(dtype=np.uint64).tobytes() + len(x).to_bytes(8, "little") if len(x) else None for x in sets]
                keys = [part_keys(x, percent).view(np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sizes, pa.array(sums, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "class", "keys"])
        forget()

    named = materialize(texts.mapInArrow(name, "id long, n_shingles long, class binary, keys array<long>"), "named")
    full = named.where("id is not null and n_shingles > 0")
    classes = materialize(full.groupBy("class").agg(F.min("id").alias("node")), "classes")
    # a class is searched for its smallest id
    nodes = full.where(F.size("keys") > 0).join(classes.select("class", F.col("node").alias("id")), ["class", "id"], "left_semi").dropDuplicates(["id", "class"])
    entries = materialize(nodes.select("id", "keys"), "nodes").select(F.explode("keys").alias("key"), F.col("id").alias("node"))
    # parts with the same members are searched once: these have equal sums of hashes, 96 bits in all
    digest = [F.sum(F.shiftright(F.xxhash64("node", F.lit(k)), 32)).alias(f"h{k}") for k in range(3)]
    found = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"), *digest).where("first < last")
    scheme = F.col("key").bitwiseAND(F.lit(255))
    keys = materialize(found.groupBy("n", "first", "last", "h0", "h1", "h2", scheme.alias("scheme")).agg(F.min("key").alias("key")).select("key"), "parts")
    members = materialize(entries.join(keys, "key").distinct(), "members")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, run in batches_of_text(batch, 1, 1 << 20):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                made = [(i, s, len(x), bitmap(x, schemes(percent)[s].bits).tobytes()) for i, x in zip(ids, (shingle_set(x, shingle) for x in run), strict=True) for s in _of_size(len(x), percent)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["node", "scheme", "n", "bits"])
        forget()

    concerned = materialize(members.select(F.col("node").alias("id")).distinct(), "concerned")
    held = materialize(texts.join(sized(concerned), "id", "left_semi").mapInArrow(draw, "node long, scheme int, n long, bits binary").distinct(), "bitmaps")
    pairs = materialize(_candidates(members.withColumn("part", F.col("node")), held, percent, spanning=True), "pairs")
    links = materialize(confirmed(texts, pairs, shingle, percent), "links")
    parts = materialize(components(links), "components")
    labelled = members.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = labelled.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    left = materialize(labelled.join(mixed, "key"), "mixed")
    rest = _candidates(left, held, percent, spanning=False).join(pairs, ["a", "b"], "left_anti")
    more = materialize(confirmed(texts, rest, shingle, percent), "more")
    if not more.isEmpty():
        parts = materialize(components(links.unionByName(more)), "components")
    of_class = classes.join(parts, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    out = named.select("id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
