"""Search for windows that occur more than once in a corpus, by sampled suffixes.

Shared by the suffix-array and the substring operators. Documents are dealt to
homes of about a fixed number of bytes. Three passes read a home's texts; the
exchange of the texts is planned once and reused.

1. Each home names the stretches that start at cover positions (the position
   in its document, modulo the period, lies in a difference cover) and sends
   its distinct names to buckets, ordered ranges of names. A bucket sorts what
   it got and compares neighbours: a bit goes back for each name that another
   home has too. Two equal windows have equal sampled stretches at a common
   shift below the period, so that only windows around repeated samples remain.
2. These windows are named at full length, merged in the buckets in the same
   way, and again a bit comes back.
3. Each home turns the repeated windows into spans of its documents.

A home sends a name once, however often it has it, so that a passage which a
third of all documents share adds one entry a home. Exact copies of a text are
found by digest beforehand, a row for each text of a home; one of them stands
for all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.columns import col, others
from gyre.llm.names import byte_names, difference_cover, symbol_names
from gyre.llm.words import word_hashes
from gyre.session import ship, trim

_LAST = np.iinfo(np.int64).max
_BLOB = "_bucket long, _home long, _keys binary, _values binary"
_REPLY = "_home long, _round int, _bucket long, _bits binary, _n long, _id long"


@dataclass(frozen=True)
class Search:
    """What to look for. kind: byte or word. earlier: a window counts only if a
    document with a smaller id has it, else if it starts anywhere else."""

    kind: str
    window: int
    period: int
    earlier: bool
    homes: int
    buckets: tuple[int, int]

    @property
    def sample(self) -> int:
        return self.window - self.period + 1


def _binary(column: pa.ChunkedArray) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def removed(spans: list[np.ndarray]) -> pa.Array:
    """How many symbols the spans of each row hold."""
    return pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64())


def span_column(spans: list[np.ndarray]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], kind)


class _Home:
    """The symbols of a home's documents and the names asked of them."""

    def __init__(self, docs: pa.Table, replies: pa.Table, s: Search):
        self.s = s
        self.texts = _binary(docs["_text"])
        ids = docs["_id"].cast(pa.int64())
        self.ids = ids.fill_null(_LAST).to_numpy()
        own = replies.filter(pc.equal(replies["_round"], 0))
        # the smallest id of each text that has copies; the text with that id stands for them
        least = dict(zip(own["_bits"].to_pylist(), own["_id"].fill_null(_LAST).to_pylist(), strict=True))
        first = [least.get(md5(t, usedforsecurity=False).digest()) for t in self.texts]
        self.grouped = np.array([f is not None for f in first], bool)
        self.copy = np.array([f is not None and f != i for f, i in zip(first, self.ids.tolist(), strict=True)], bool)
        if s.kind == "byte":
            self.lengths = np.array([len(t) for t in self.texts], np.int64)
        else:
            self.symbols = [word_hashes(t) for t in self.texts]
            self.lengths = np.array([len(w) for w in self.symbols], np.int64)
        self.judged = np.flatnonzero(~self.copy & (self.lengths >= s.window))
        self.cover = difference_cover(s.period)
        self._sampled()

    def _names(self, doc: int, length: int, where: np.ndarray) -> np.ndarray:
        if self.s.kind == "byte":
            return byte_names(np.frombuffer(self.texts[doc], np.uint8), length, where)
        return symbol_names(self.symbols[doc], length)[where]

    def _sampled(self) -> None:
        s, self.where, names = self.s, [], []
        for doc in self.judged:
            n = int(self.lengths[doc]) - s.sample + 1
            w = (np.arange(0, n, s.period)[:, None] + self.cover[None, :]).ravel()
            self.where.append(w[w < n])
            names.append(self._names(doc, s.sample, self.where[-1]))
        all_names = np.concatenate(names) if names else np.empty(0, np.uint64)
        bucket = (all_names >> np.uint64(32)) * np.uint64(s.buckets[0]) >> np.uint64(32)
        # a filter: 32 bits within a bucket do, as a chance hit costs a few windows more
        short = bucket << np.uint64(32) | all_names & np.uint64(0xFFFFFFFF)
        self.keys, self.inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
        self.twice = counts > 1

    def blobs(self, home: int, keys: np.ndarray, values: np.ndarray | None, which: int) -> pa.Table:
        short = which == 0
        bucket = keys >> np.uint64(32) if short else (keys >> np.uint64(32)) * np.uint64(self.s.buckets[1]) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.empty(0, np.int64)
        ends = np.r_[starts, len(keys)][1:]
        stored = keys.astype(np.uint32) if short else keys
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        # the rounds have buckets of their own
        return pa.table({
            "_bucket": pa.array(bucket[starts].astype(np.int64) * 2 + which),
            "_home": pa.array(np.full(len(starts), home, np.int64)),
            "_keys": pa.array(cut(stored), pa.binary()),
            "_values": pa.array([None] * len(starts) if values is None else cut(values), pa.binary()),
        })

    def bits(self, replies: pa.Table, which: int, n: int) -> np.ndarray:
        own = replies.filter(pc.equal(replies["_round"], which + 1))
        rows = sorted(zip(own["_bucket"].to_pylist(), own["_n"].to_pylist(), own["_bits"].to_pylist(), strict=True))
        out = [np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for _, k, b in rows]
        out = np.concatenate(out) if out else np.empty(0, bool)
        assert len(out) == n, f"replies for {len(out)} of {n} names"
        return out

    def candidates(self, replies: pa.Table) -> None:
        """Full-length names of the windows around samples that repeat."""
        s = self.s
        hit = (self.twice | self.bits(replies, 0, len(self.keys)))[self.inverse]
        self.starts, names, values, at = [], [], [], 0
        for doc, where in zip(self.judged, self.where, strict=True):
            found = where[hit[at : at + len(where)]]
            at += len(where)
            n = int(self.lengths[doc]) - s.window + 1
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, np.minimum(np.maximum(found - s.period + 1, 0), n), 1)
            np.add.at(edge, np.minimum(found + 1, n), -1)
            w = np.flatnonzero(np.cumsum(edge[:n]) > 0)
            self.starts.append(w)
            names.append(self._names(doc, s.window, w))
            values.append(np.full(len(w), self.ids[doc]))
        names = np.concatenate(names) if names else np.empty(0, np.uint64)
        self.owner = np.concatenate(values) if values else np.empty(0, np.int64)
        self.windows, self.window_of, counts = np.unique(names, return_inverse=True, return_counts=True)
        self.windows_twice = counts > 1
        self.least = None
        if s.earlier:
            self.least = np.full(len(self.windows), _LAST)
            np.minimum.at(self.least, self.window_of, self.owner)

    def spans(self, replies: pa.Table) -> list[np.ndarray]:
        """For each document the removed stretches as rows (start, end), ascending and apart."""
        s, none = self.s, np.empty((0, 2), np.int64)
        elsewhere = self.bits(replies, 1, len(self.windows))
        hit = elsewhere[self.window_of]
        hit |= self.least[self.window_of] < self.owner if s.earlier else self.windows_twice[self.window_of]
        out, at = [none] * len(self.texts), 0
        for doc, w in zip(self.judged, self.starts, strict=True):
            found = w[hit[at : at + len(w)]]
            at += len(w)
            if len(found):
                cut = np.flatnonzero(np.diff(found) > s.window)
                out[doc] = np.c_[found[np.r_[0, cut + 1]], found[np.r_[cut, len(found) - 1]] + s.window]
        # a copy has all its windows in the text that stands for it, and so has that one, where order doesn't count
        for doc in np.flatnonzero((self.copy if s.earlier else self.grouped) & (self.lengths >= s.window)):
            out[doc] = np.array([[0, self.lengths[doc]]])
        return out


def _answer(s: Search) -> Callable[[pa.Table], pa.Table]:
    def answer(blobs: pa.Table) -> pa.Table:
        """Sort a bucket's names, compare neighbours, and tell each home which of its names others have."""
        bucket = blobs["_bucket"][0].as_py()
        which = bucket % 2
        keys = [np.frombuffer(b, np.uint64 if which else np.uint32) for b in blobs["_keys"].to_pylist()]
        sizes = np.array([len(k) for k in keys])
        k = np.concatenate(keys)
        order = np.argsort(k, kind="stable")
        k = k[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        group = np.diff(np.r_[starts, len(k)])
        bit = np.empty(len(k), bool)
        if which and s.earlier:
            v = np.concatenate([np.frombuffer(b, np.int64) for b in blobs["_values"].to_pylist()])[order]
            bit[order] = np.repeat(np.minimum.reduceat(v, starts), group) < v
        else:
            bit[order] = np.repeat(group > 1, group)
        ends = np.cumsum(sizes)
        n = len(sizes)
        return pa.table({
            "_home": blobs["_home"].combine_chunks(),
            "_round": pa.array([which + 1] * n, pa.int32()),
            "_bucket": pa.array([bucket] * n, pa.int64()),
            "_bits": pa.array([np.packbits(bit[b - m : b]).tobytes() for m, b in zip(sizes, ends, strict=True)], pa.binary()),
            "_n": pa.array(sizes.astype(np.int64)),
            "_id": pa.nulls(n, pa.int64()),
        })

    return answer


def search(
    docs: DataFrame,
    finish: Callable[[list[np.ndarray], list[bytes]], list[pa.Array]],
    outputs: T.StructType,
    *,
    id_col: str,
    text_col: str,
    kind: str,
    window: int,
    period: int,
    earlier: bool,
    home_bytes: int = 2 << 20,
    bucket_names: int = 1_500_000,
) -> DataFrame:
    """docs with the columns that finish(spans a row, texts as bytes) makes for the rows of a home.

    A null text is empty. A null id sorts after all others. Ids are integers.
    Rows alike in id and text share a home. Columns of docs with the outputs'
    names (without case) are replaced.
    """
    ship(docs.sparkSession)
    own = others(docs, outputs.names)
    schema = T.StructType([*own, *outputs.fields])
    # inside, columns go by number, so that none clashes with the search's own
    inside = {"_id": id_col, "_text": text_col}
    carried = [next((k for k, v in inside.items() if v.lower() == f.name.lower()), f"c{i}") for i, f in enumerate(own)]
    extra = {k: v for k, v in inside.items() if k not in carried}
    docs = docs.select(*[col(f.name).alias(c) for f, c in zip(own, carried, strict=True)], *[col(v).alias(k) for k, v in extra.items()])
    text, key = F.col("_text"), F.col("_id")
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    homes = max(1, -(-n_bytes // home_bytes))
    symbols = n_bytes if kind == "byte" else n_bytes // 6
    share = len(difference_cover(period)) / period
    s = Search(kind, window, period, earlier, homes, (max(1, int(symbols * share) // bucket_names), max(1, symbols // 4 // bucket_names)))

    def home(digest: Column) -> Column:
        return F.pmod(F.xxhash64(key, digest), F.lit(homes)).cast("long")

    dealt = docs.withColumn("_home", home(F.xxhash64(text)))
    # a home names a text once, however many copies it has, so that a hot text has a row a home
    digests = docs.where(F.octet_length(text) >= window).select(key.cast("long").alias("_id"), F.unhex(F.md5(text)).alias("_digest"), home(F.xxhash64(text)).alias("_home"))
    digests = digests.groupBy("_home", "_digest").agg(F.min("_id").alias("_id"), F.count("*").alias("_n"))
    classes = digests.groupBy("_digest").agg(F.min("_id").alias("_least"), F.sum("_n").alias("_n")).where("_n > 1").drop("_n")
    copies = digests.join(classes, "_digest").select(
        "_home", F.lit(0).alias("_round"), F.lit(None).cast("long").alias("_bucket"), F.col("_digest").alias("_bits"),
        F.lit(None).cast("long").alias("_n"), F.col("_least").alias("_id"),
    )

    def ask_samples(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _empty_blobs()
        trim()
        h = _Home(own, replies, s)
        return h.blobs(own["_home"][0].as_py(), h.keys, None, 0)

    def ask_windows(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _empty_blobs()
        trim()
        h = _Home(own, replies, s)
        h.candidates(replies)
        return h.blobs(own["_home"][0].as_py(), h.windows, h.least, 1)

    def finished(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if rows.num_rows:
            trim()
            h = _Home(rows, replies, s)
            h.candidates(replies)
            added = finish(h.spans(replies), h.texts)
        else:
            added = finish([], [])
        return pa.table([*(rows[c] for c in carried), *added], names=schema.names)

    by_home = lambda df: df.groupBy("_home")
    answer = _answer(s)
    first = by_home(dealt).cogroup(by_home(copies)).applyInArrow(ask_samples, _BLOB)
    first = copies.unionByName(first.groupBy("_bucket").applyInArrow(answer, _REPLY))
    second = by_home(dealt).cogroup(by_home(first)).applyInArrow(ask_windows, _BLOB)
    second = first.unionByName(second.groupBy("_bucket").applyInArrow(answer, _REPLY))
    return by_home(dealt).cogroup(by_home(second)).applyInArrow(finished, schema)


def _empty_blobs() -> pa.Table:
    return pa.table({"_bucket": pa.nulls(0, pa.int64()), "_home": pa.nulls(0, pa.int64()), "_keys": pa.nulls(0, pa.binary()), "_values": pa.nulls(0, pa.binary())})
