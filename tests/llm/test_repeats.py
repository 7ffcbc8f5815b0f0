"""Suffix and substring removal against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from gyre.llm.names import byte_names, difference_cover, lengths, symbol_names
from gyre.llm.repeats import removed, search
from gyre.llm.substring import remove_earlier_passages
from gyre.llm.suffix import kept_bytes, remove_repeated_bytes, remove_repeated_passages


def brute_bytes(rows, length):
    where = {}
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(t[p : p + length], []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = b"\1" * length
    return sorted((str(d), bytes(c for c, g in zip(t, k) if not g), sum(k)) for (d, _), t, k in zip(rows, texts, gone))


def brute_words(rows, window):
    least = {}
    words = [(t or "").split() for _, t in rows]
    key = lambda d: float("inf") if d is None else d
    for (d, _), w in zip(rows, words):
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, float("inf")), key(d))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < key(d):
                gone[p : p + window] = [True] * window
        out.append((str(d), " ".join(x for x, g in zip(w, gone) if not g), sum(gone)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("a bé cc ddd ôo x y zz".split())
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 3), r.choice(passages))
        rows.append((d * 3, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    rows += [(300, None), (301, ""), (None, rows[2][1]), (None, "x " * 40), (302, "x " * 40), (302, "x " * 40), (303, "ab" * 300), (304, "q")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "keep", 7) for d, t in rows], "doc_id long, text string, n_removed string, extra int").repartition(3)
    got = remove_repeated_bytes(df, length=40, period=13).collect()
    assert sorted((str(x.doc_id), bytes(x.kept), x.n_removed) for x in got) == brute_bytes(rows, 40)
    assert all(x.extra == 7 and sum(s.end - s.start for s in x.spans) == x.n_removed for x in got)
    got = remove_earlier_passages(df, window=12, period=7).collect()
    assert sorted((str(x.doc_id), x.kept, x.n_removed) for x in got) == brute_words(rows, 12)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).collect() == [] and remove_earlier_passages(df).collect() == []


@pytest.mark.parametrize("period", [7, 13, 21, 31, 57, 73, 91, 133, 50])
def test_covers(period):
    d = difference_cover(period)
    assert {(int(a) - int(b)) % period for a in d for b in d} == set(range(period))


def test_names():
    data = np.frombuffer(bytes(random.Random(3).choices(b"ab", k=3000)), np.uint8)
    for length in (7, 20, 64):
        assert lengths(5, length)[-1] == length
        n = byte_names(data, length)
        by_bytes = {}
        for p, x in enumerate(n.tolist()):
            assert by_bytes.setdefault(data[p : p + length].tobytes(), x) == x
        assert len(set(by_bytes.values())) == len(by_bytes)
        where = np.arange(3, len(n), 7)
        assert (byte_names(data, length, where) == n[where]).all()
    assert len(symbol_names(np.arange(5, dtype=np.uint64), 6)) == 0


def brute_passages(rows, words):
    """Bytes left when runs of so many words go that start anywhere else."""
    where = {}
    split = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    texts = [(t or "").encode() for _, t in rows]
    for i, spans in enumerate(split):
        for p in range(len(spans) - words + 1):
            where.setdefault(tuple(texts[i][a:b] for a, b in spans[p : p + words]), []).append((i, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                a, b = split[i][p][0], split[i][p + words - 1][1]
                gone[i][a:b] = b"\1" * (b - a)
    return sorted((str(d), bytes(c for c, g in zip(t, k) if not g).decode()) for (d, _), t, k in zip(rows, texts, gone))


@pytest.mark.parametrize("seed", [3, 4])
def test_passages_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(x.doc_id), x.kept) for x in remove_repeated_passages(df, words=12, period=7).collect()) == brute_passages(rows, 12)


def test_full_length_in_many_homes_and_buckets(spark):
    """400 bytes, period 133, with texts dealt to many homes and names to many buckets."""
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(("lorem", "ipsum", "dolor", "sit", "amet", "ünd", "x")) + str(r.randint(0, 40)) for _ in range(n))
    shared = [prose(n) for n in (50, 60, 70, 90, 200)]
    rows = [(i, " ".join([prose(r.randint(0, 120)), r.choice(shared) if i % 3 else "", prose(r.randint(0, 60))])) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(8)] + [(2000, "ab" * 900), (2001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spans = lambda found, texts: [removed(found), pa.array([kept_bytes(t, s) for t, s in zip(texts, found, strict=True)], pa.binary())]
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("kept", T.BinaryType())])
    out = search(df, spans, schema, id_col="doc_id", text_col="text", kind="byte", window=400, period=133, earlier=False, home_bytes=6_000, bucket_names=300).collect()
    assert sorted((str(x.doc_id), bytes(x.kept), x.n) for x in out) == brute_bytes(rows, 400)
    assert sum(x.n for x in out) > 10_000


def test_clashing_names(spark):
    rows = [(1, "p " * 300, "k"), (2, "p " * 300, "k")]
    df = spark.createDataFrame([(*r, "o", "h", 1) for r in rows], "doc_id long, Text string, Kept string, _home string, c0 string, _round int")
    for out in (remove_repeated_bytes(df, text_col="Text"), remove_repeated_passages(df, text_col="Text"), remove_earlier_passages(df, text_col="Text")):
        assert {"_home", "c0", "_round"} <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)
        assert {(x._home, x.c0, x._round) for x in out.collect()} == {("o", "h", 1)}
