import random

import numpy as np
import pytest

from gyre.llm.components import components
from gyre.llm.minhash import near_duplicates, shingle_set, sketches


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets[d] = s
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    r = random.Random(size)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = []
    for g in range(25):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 2, " ".join(w).upper().replace("É", "é") if r.random() < 0.3 else "\n".join(w)))
    rows += [(9001, None), (9002, ""), (9003, " \t"), (9004, "one"), (9005, "ONE"), (9006, rows[0][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int").repartition(5)
    got = near_duplicates(df, shingle=size)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, size, 80)


def test_screening_in_blocks(spark, monkeypatch):
    """Texts that are alike, but mostly not enough, in one large bucket."""
    from gyre.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 20)
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(3, 9)):
            w[r.randrange(60)] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, bands=60, rows=2)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 2, 80)


def test_nulls_ties_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(map(str, near_duplicates(df, shingle=2).collect()))
    assert len(got) == 5 and sum("component_id=1" in x for x in got) == 2
    assert near_duplicates(df.limit(0)).collect() == []


def test_sketch_estimates():
    r = np.random.default_rng(1)
    for n in (1, 3, 50, 3000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        b[: n // 5] = r.integers(0, 2**63, n // 5).astype(np.uint64)
        s = sketches(np.r_[a, b], np.repeat([0, 1], n), 2, 240)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        j = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - j) < 0.12
    assert len(shingle_set(b"a b a b a b", 2)) == 2


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + r.randint(1, 30)) for _ in range(40)] + [(200 + r.randint(0, 60), 200 + r.randint(0, 60)) for _ in range(50)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {x: find(x) for x in parent}


def test_screening_keeps_elements_that_agree_in_half_their_bits():
    """80 common elements of 100, two of them equal in their low 32 bits, are a link; so are they in either half."""
    from gyre.llm.minhash import _passing

    for shift in (32, 0):
        common = np.arange(80, dtype=np.uint64) << np.uint64(33)
        common[1] = common[0] + (np.uint64(1) << np.uint64(shift))
        a = np.sort(np.r_[common, np.arange(10, dtype=np.uint64) + np.uint64(1 << 60)])
        b = np.sort(np.r_[common, np.arange(10, dtype=np.uint64) + np.uint64(1 << 61)])
        part = np.arange(2)
        assert list(_passing([a, b], part, None, 80)) == [(0, 1)]
        many = [a, b, *(np.arange(100, dtype=np.uint64) + np.uint64(k << 50) for k in range(1, 30))]
        assert list(_passing(many, np.arange(len(many)), None, 80)) == [(0, 1)]
