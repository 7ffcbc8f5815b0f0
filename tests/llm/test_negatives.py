"""Hard negatives against brute force, and the bounds of the vector-approximation file."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, n_pos=5, n_neg=5, percent=80):
    good = [(i, [math.floor(256 * x) for x in np.array(v, np.float32).astype(float).tolist()], label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = sorted({len(v) for _, v, _ in good}, key=lambda n: (-sum(len(v) == n for _, v, _ in good), n))
    good = [(i, tuple(v), label) for i, v, label in good if len(v) == sizes[0]]
    good = list(dict.fromkeys(good))
    out = set()
    for a, q, label in good:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, v, other in good if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:n_pos]:
            window = [(s, i) for s, i, other in scored if other != label and -p * percent <= -s * 100 <= -p * 100][:n_neg]
            out |= {(a, pid, k, i, -p, -s) for k, (s, i) in enumerate(window, 1)}
    return sorted(out)


def made(seed, n=500, d=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = centres[r.integers(6)] + r.normal(size=d) * 0.7
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(r.integers(4))))
    same = rows[3][1]
    rows += [(n + i, same, i % 4) for i in range(120)]  # copies in all labels: ties by id
    rows += [(5000, None, 1), (5100, [None] * d, 1), (5200, [float("nan")] + [0.0] * (d - 1), 2), (5300, [float("inf")] * d, 2), (5400, [0.1] * d, None), (5500, [0.1] * (d - 1), 1), (5600, [], 1), (5700, [0.0] * d, 1), (None, [0.5] * d, 1)]
    return rows


@pytest.mark.parametrize("block", [4096, 7])
def test_against_brute_force(spark, block):
    """Extra columns with clashing names are dropped; few anchors a block, so that several passes are made; a repeated row counts once."""
    rows = made(block)
    df = spark.createDataFrame([(*x, 9) for x in [*rows, rows[3], rows[0]]], SCHEMA + ", rank int").repartition(5)
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_edge_cases(spark):
    for rows in ([], [(0, None, None)], [(1, [0.5], 1)], [(0, [0.5], 1)]):
        assert N.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        N.hard_negatives(spark.createDataFrame([(0, [1e9, 1e9], 1)], SCHEMA), F.col("vec_id") == 0).collect()


def test_bounds_hold_and_spare_scores(spark):
    """Each score lies between its bounds; few pairs are scored exactly."""
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 32))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    rows = N.quantised(spark.createDataFrame([(i, x.tolist(), i % 5) for i, x in enumerate(v)], SCHEMA), "vec_id", "label", "embedding", 256.0)
    edges, low, high = N.cell_edges(rows, fit_rows=200)
    file = N.approximation_file(rows, edges, 6).toArrow().combine_chunks().to_batches()[0]
    matrix = np.array(file["vec"].to_pylist())
    cells = N.cell_of(matrix, edges)
    anchors = matrix[:20]
    least, most = N.bounds(cells, N.bound_tables(anchors, low, high))
    exact = matrix @ anchors.T
    assert (least <= exact).all() and (exact <= most).all() and np.median(most - least) < 8000
    best = N.Best(5, 20)
    labels = [x % 5 for x in range(20)]
    scored = sum(N.search(file.slice(lo, 500), best, anchors, labels, np.arange(20) - 100, (low, high), [np.array([k]) for k in range(20)], None, None) for lo in range(0, 3000, 500))
    assert scored < 0.1 * 20 * 3000
    own = np.array(file["label"].to_pylist())
    for k in range(20):
        at = np.flatnonzero(own == labels[k])
        want = np.sort(exact[at, k])[::-1][:5]
        assert best.score[k].tolist() == want.tolist()


def test_values_beyond_the_sample_have_cells():
    edges = np.array([[0, 10, 20]])
    assert N.cell_of(np.array([[-999], [0], [9], [10], [20], [10**6]]), edges)[:, 0].tolist() == [0, 1, 1, 2, 3, 3]
