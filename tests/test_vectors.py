"""Searches by blocks of queries, vectors as bytes, inverted lists."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gyre.functions import vectors as V
from gyre.operators.index import Lists, assign, fit_lists, search_lists

R = np.random.default_rng(3)
ROWS = [(i, R.normal(size=8).round(3).tolist()) for i in range(300)] + [(300, [0.0] * 8), (301, None), (302, [1.0, 2.0])]
ROWS += [(303, ROWS[5][1]), (304, ROWS[5][1])]  # ties


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "vec_id long, embedding array<float>").repartition(4)


def asked(rows):
    return rows.where("vec_id IN (5, 17, 300)").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def brute(metric, k):
    whole = [(i, np.array(v, np.float32).astype(float)) for i, v in ROWS if v is not None and len(v) == 8]
    out = []
    for qid, q in whole:
        if qid in (5, 17, 300):
            scored = []
            for i, v in whole:
                n = np.sqrt(v @ v) * np.sqrt(q @ q)
                s = {"cosine": float(v @ q / n) if n > 1e-8 else 0.0, "l2": float(np.sqrt(((v - q) ** 2).sum())), "ip": -float(v @ q)}[metric]
                scored.append((-s if metric == "cosine" else s, i, s))
            out += [(qid, i, round(s, 9), rank) for rank, (_, i, s) in enumerate(sorted((round(a, 12), i, s) for a, i, s in scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("most", [1, 10_000])  # a block for each query, or one for all
def test_nearest(spark, rows, metric, most):
    got = V.nearest(asked(rows), rows, 7, metric, most_queries=most).collect()
    assert sorted((x.qid, x.vec_id, round(x.score, 9) + 0.0, x.rank) for x in got) == brute(metric, 7)


def test_ties_come_by_id(spark, rows):
    got = V.nearest(asked(rows).where("qid = 5"), rows, 3).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [5, 303, 304]


def test_similar_and_scores(spark, rows):
    every = {(x.qid, x.vec_id): x.score for x in V.scores(asked(rows), rows).collect()}
    assert len(every) == 3 * 303
    near = {(x.qid, x.vec_id) for x in V.similar(asked(rows), rows, 0.5).collect()}
    assert near == {k for k, s in every.items() if s >= 0.5}


def test_no_queries(spark, rows):
    assert V.nearest(asked(rows).where("false"), rows, 3).count() == 0 and V.nearest(asked(rows), rows.where("false"), 3).count() == 0


def test_bytes(spark, rows):
    e = rows.where("vec_id < 300").select("vec_id", "embedding", V.to_bytes("embedding", True).alias("h"), V.to_bytes("embedding", False).alias("s"))
    for x in e.select("embedding", F.octet_length("h").alias("n"), V.from_bytes("h", True).alias("h"), V.from_bytes("s", False).alias("s")).collect():
        assert x.n == 16 and x.s == x.embedding and x.h == np.array(x.embedding, np.float16).astype(np.float32).tolist()


def test_list_cosine(spark):
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    x = pair.select(V.list_cosine(F.col("a"), F.col("b")).alias("ab"), V.list_cosine(F.col("a"), F.col("z")).alias("az")).first()
    assert x.ab == pytest.approx(2**-0.5) and x.az == 0.0


def test_lists_hold_every_row_and_find_most(spark):
    """Clustered vectors: recall of nine in ten at least, looking into a part of the lists."""
    r = np.random.default_rng(9)
    centres = r.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + 0.2 * r.normal(size=16)).tolist()) for i in range(2000)] + [(5000, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    index = fit_lists(df, "embedding", centres=25)
    lists = assign(df, index, "embedding").persist()
    assert lists.count() == 2001 and lists.where("list = -1").count() == 1 and index.probes < 20
    q = df.where("vec_id % 100 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(x.qid, x.vec_id) for x in V.nearest(q, df, 10).collect()}
    found = {(x.qid, x.vec_id) for x in search_lists(q, lists, index, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_lists_are_fitted_on_the_smallest_hashes(spark):
    """The sample is the rows with the smallest hashes however they are dealt; those of another length than most, or without a vector, take no part."""
    r = np.random.default_rng(8)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(3000, 4)))], "vec_id long, embedding array<double>")
    wanted = [x.embedding for x in df.orderBy(F.xxhash64("embedding")).limit(150).collect()]
    index = fit_lists(df.repartition(5), "embedding", sample=150, centres=150)
    units = np.array(wanted) / np.linalg.norm(wanted, axis=1, keepdims=True)
    # as many centres as rows of the sample: each is its own centre
    assert sorted(map(tuple, index.centres.round(9))) == sorted(map(tuple, units.round(9)))
    odd = spark.createDataFrame([(5000, None), (5001, [1.0, 2.0]), (5002, [])], df.schema)
    assert fit_lists(df.union(odd), "embedding", centres=10).centres.shape == (10, 4)
    assert fit_lists(odd.where("embedding IS NULL"), "embedding").probes == 0


def test_lists_are_searched_where_they_lie(spark):
    """The k nearest of a query's lists, equals by id, as a plain search has them; pairs aren't joined, and a query of another length has no lists."""
    r = np.random.default_rng(5)
    data = r.normal(size=(600, 8))
    data[300:330] = data[300]  # copies
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)] + [(700, None), (800, [1.0, 2.0])], "vec_id long, embedding array<double>").repartition(3)
    index = Lists(data[:40:2] / np.linalg.norm(data[:40:2], axis=1, keepdims=True), 3)
    lists = assign(df, index, "embedding").persist()
    q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = search_lists(q, lists, index, 10)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    own = (data @ index.centres.T).argmax(axis=1)
    wanted = {}
    for i in range(0, 600, 100):
        mine = np.flatnonzero(np.isin(own, np.argsort(-(data[i] @ index.centres.T))[:3]))
        wanted |= {(i, int(j)): float(units[i] @ units[j]) for j in sorted(mine, key=lambda j: (-round(float(units[i] @ units[j]), 9), j))[:10]}
    assert {(x.qid, x.vec_id): x.score for x in found.collect()} == pytest.approx(wanted)


def test_rows_of_several_groups_share_a_querys_best(spark):
    """Queries with an array of groups: the k nearest of all of these together, of the null group too if it is named, and of no other."""
    data = [(i, [float(i % 7 + 1), float(i % 11)], None if i % 4 == 3 else i % 4) for i in range(90)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 2.0], [0, 2]), (2, [3.0, 1.0], [None]), (3, [1.0, 1.0], []), (4, [1.0, 1.0], None)], "qid long, qvec array<double>, label array<int>")
    found = {}
    for x in V.nearest(q, df, 5, "l2", group="label", own=True).collect():
        found.setdefault(x.qid, []).append((x["rank"], x.vec_id))
    for qid, vec, groups in ((1, (1, 2), (0, 2)), (2, (3, 1), (None,))):
        near = sorted((math.dist(vec, v), i) for i, v, label in data if label in groups)[:5]
        assert sorted(found[qid]) == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert found.keys() == {1, 2}


def test_two_measures_in_one_pass(spark, rows):
    both = {(x.qid, x.vec_id): (x.score, x.cosine) for x in V.scores(asked(rows), rows, "ip", also="cosine").collect()}
    for at, metric in enumerate(("ip", "cosine")):
        assert {k: v[at] for k, v in both.items()} == pytest.approx({(x.qid, x.vec_id): x.score for x in V.scores(asked(rows), rows, metric).collect()}, abs=1e-12)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_pairs_are_measured_in_bounded_steps(spark, rows, metric, monkeypatch):
    """However many queries meet a batch of rows, PAIRS are measured at once at most."""
    import tracemalloc

    ids = np.arange(1000)
    data = R.normal(size=(1000, 64))
    seen = {}

    def run(f, schema):
        seen["f"] = f
        return rows.limit(0).select(F.lit(0).alias("qid"), F.lit(0).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("_group"))

    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: run(f, schema))
    q = spark.createDataFrame([(i, data[i].tolist()) for i in range(500)], "qid long, qvec array<double>")
    V.scores(q, q.select(F.col("qid").alias("vec_id"), F.col("qvec").alias("embedding")), metric)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(data.tolist()), pa.array([0] * 1000)], ["vec_id", "embedding", "_group"])
    tracemalloc.start()
    n = [b.num_rows for b in seen["f"](iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n) == 500_000 and max(n) <= V.PAIRS and peak < 100e6
