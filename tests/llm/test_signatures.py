import random

import numpy as np
import pytest

from gyre.llm import signatures
from gyre.llm.minhash import shingle_set
from gyre.llm.signatures import Tree, bitmap, part_keys, schemes, similar_documents, traverse
from tests.llm.test_minhash import brute


def texts(seed, groups=40, vocabulary=300, edits=40, longest=200):
    r = random.Random(seed)
    words = [f"w{i}é" for i in range(vocabulary)]
    rows = []
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 8, 12, 30, 60, longest]))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // edits))):
                w[r.randrange(len(w))] = r.choice(words)
            if r.random() < 0.2:
                w = w[: max(1, int(len(w) * 0.93))]
            rows.append((len(rows) * 2, " ".join(w).upper().replace("É", "é") if r.random() < 0.3 else "\n".join(w)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (1, 80)])
def test_against_brute_force(spark, size, percent):
    rows = [*texts(size), (9001, None), (9002, ""), (9003, " \t"), (9004, "one"), (9005, "ONE")]
    rows.append((9006, rows[0][1]))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = similar_documents(df, shingle=size, percent=percent)
    assert sorted(tuple(x) for x in got.collect()) == [x[:3] for x in brute(rows, size, percent)]
    assert len({x[2] for x in brute(rows, size, percent)}) < len(rows) - 20


def test_blocks_and_empty_parts(spark, monkeypatch):
    """Large groups in small blocks; few variants, so that empty parts are named; a link that only a chain shows."""
    monkeypatch.setattr(signatures, "BLOCK", 7)
    monkeypatch.setattr(signatures, "VARIANTS", 1)
    r = random.Random(3)
    base = [f"v{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + d, t) for d, t in texts(11, groups=10)]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == [x[:3] for x in brute(rows, 3, 90)]


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    assert similar_documents(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"z{i}" for i in range(30_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (3, None), (4, long), (5, long + " end"), (None, None), (6, "a b c")]
    got = sorted(map(tuple, similar_documents(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3), (4, 29_998, 4), (5, 29_999, 4), (None, 0, None), (6, 1, 6)], key=str)


def test_rows_that_share_an_id_are_one_document(spark):
    """Its texts link it to both groups."""
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (7, a + " x"), (7, b), (9, b + " y")]
    got = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x.doc_id, x.component_id) for x in got.collect()} == {(1, 1), (7, 1), (9, 1)}


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_part(percent):
    r = np.random.default_rng(percent)
    met = 0
    for n in [*range(1, 60), 100, 300, 1000]:
        for _ in range(8):
            pool = r.integers(0, 1 << 63, 3 * n + 40, dtype=np.uint64)
            both = pool[:n]
            for x, y in ((0, n // 9), (n // 20, n // 20), (n // 12, 0)):
                a, b = np.unique(np.r_[both, pool[n : n + x]]), np.unique(np.r_[both, pool[2 * n : 2 * n + y]])
                if 100 * n >= percent * (n + x + y) and x + y:
                    met += 1
                    assert np.intersect1d(part_keys(a, percent), part_keys(b, percent)).size
    assert met > 500
    for s in schemes(percent)[:20]:
        assert s.reach >= s.top and s.parts > (100 - percent) * 2 * s.low // (100 + percent)


def test_traversal_loses_no_pair_and_prunes():
    """Against all pairs of the same sets; unrelated groups are ruled out above the leaves."""
    r = random.Random(5)
    sets, part = [], []
    for g in range(40):
        base = [f"g{g}w{r.randrange(10**5)}" for _ in range(r.randint(130, 190))]
        for _ in range(6):
            w = list(base)
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            sets.append(shingle_set(" ".join(w).encode(), 3))
            part.append(g // 3 if r.random() < 0.5 else 1000 + len(part))
    bits, size, part = np.stack([bitmap(x, 1024) for x in sets]), np.array([len(x) for x in sets]), np.array(part)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if part[i] != part[j] and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (size[i] + size[j] - n)}
    tree = Tree(bits, size, part)
    found = {(min(p), max(p)) for i, j in traverse(tree, tree, 90) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert want <= found and len(want) > 200
    assert len(found) < 2 * len(want)
    half = len(sets) // 2
    crossed = {(i, j + half) for x, y in traverse(Tree(bits[:half], size[:half], part[:half]), Tree(bits[half:], size[half:], part[half:]), 90) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in want if p[0] < half <= p[1]} <= crossed
