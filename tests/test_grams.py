"""Dot products of sparse rows with questions."""

import re

import pytest

from gyre.operators.grams import sparse_dots


@pytest.mark.parametrize("most", [1, 10])  # a block for each question or so, or one for all
def test_sparse_dots(spark, most):
    asked = spark.createDataFrame([(1, ["a", "b"], [1.0, 2.0]), (2, ["b"], [3.0]), (3, ["z"], [1.0])], "q long, terms array<string>, weights array<double>")
    rows = spark.createDataFrame([(7, ["b", "c"], [5.0, 1.0]), (8, ["a", "b"], [1.0, 1.0]), (9, ["c"], [1.0]), (10, [], [])], "r long, terms array<string>, weights array<double>")
    found = sparse_dots(asked, rows, ["q"], ["r"], most)
    assert sorted((x.q, x.r, x.dot) for x in found.collect()) == [(1, 7, 10.0), (1, 8, 3.0), (2, 7, 15.0), (2, 8, 3.0)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_of_tiles(spark, monkeypatch):
    """terms that most rows have and terms that few have, in several tiles; no row of either side passes through the driver, and no pair is shuffled."""
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(5)

    def rows(n):
        held = [np.unique(np.minimum(rng.zipf(1.3, 40), 900)) for _ in range(n)]
        return [(i, i % 3, [f"t{t}" for t in h], [float(x) for x in rng.random(len(h)) + 0.1]) for i, h in enumerate(held)]

    a, b = rows(150), rows(90)
    kinds = "k long, m long, terms array<string>, weights array<double>"
    left, right = (spark.createDataFrame(x, kinds.replace("k ", f"{s}k ").replace("m ", f"{s}m ")) for s, x in (("a", a), ("b", b)))
    with monkeypatch.context() as m:
        for way in ("collect", "toPandas", "toLocalIterator", "toArrow"):
            m.setattr(DataFrame, way, None)
        found = sparse_dots(left, right, ["ak", "am"], ["bk", "bm"], 40)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    v = [{(k, m): dict(zip(t, w, strict=True)) for k, m, t, w in x} for x in (a, b)]
    want = {(*p, *q): sum(w * y[t] for t, w in x.items() if t in y) for p, x in v[0].items() for q, y in v[1].items() if x.keys() & y.keys()}
    assert len(got) == len(want) and {tuple(r)[:4]: r.dot for r in got} == pytest.approx(want)


def test_hashed_counts_where_rows_lie(spark):
    """Counts by hash as of plain Python, of rows without tokens as well, and no shuffle."""
    import hashlib
    from collections import Counter

    from gyre.operators.grams import hashed_counts

    rows = [("x", ["a", "b", "a", "é"]), ("y", []), ("z", None), ("u", [f"w{i}" for i in range(300)])]
    found = hashed_counts(spark.createDataFrame(rows, "id string, ts array<string>"), "id", "ts")
    want = {i: dict(Counter(hashlib.md5(t.encode()).digest()[0] % 64 for t in ts or [])) for i, ts in rows}
    assert {x.id: x.vector for x in found.collect()} == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def _all_pairs(turns):
    """All answers against all contexts by hand: rows (conv_id, turn, role, text) to {(answer's key, context's key): cosine}."""
    import math
    from collections import Counter, defaultdict

    def grams(text):
        for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()):
            if w:
                yield from (f" {w} "[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n))

    a = [(c, t, (x or "")[:4000]) for c, t, role, x in turns if role == "assistant"]
    b = [(c, t, (x or "")[:4000]) for c, t, _ in a if c is not None and t is not None for c2, t2, _, x in turns if (c2, t2) == (c, t - 1)]
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for side, rows in zip(counts, (a, b), strict=True):
        for c, t, x in rows:
            side[c, t].update(grams(x))
    df = Counter(g for side in counts for held in side.values() for g in held)
    unit = []
    for side in counts:
        v = {k: {g: (1 + math.log(m)) * (math.log((1 + len(a) + len(b)) / (1 + df[g])) + 1) for g, m in held.items()} for k, held in side.items() if None not in k}
        unit.append({k: {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()} for k, w in v.items()})
    return {(p, q): sum(x * y[g] for g, x in w.items() if g in y) for p, w in unit[0].items() for q, y in unit[1].items() if w.keys() & y.keys()}


def test_every_answer_asks_every_context(spark, tmp_path):
    """no answer is left out by its id; keys that come twice, are missing, or have no words too; the SQL says the same."""
    import duckdb

    from gyre.plans import catalog

    turns = [(c, t, "assistant" if t % 2 else "user", f"Word{c % 3} and tone{t} {'ab' * (c % 5)} é𝄞x{c}\nand") for c in (0, 1, 7, 10, 55, 100, 113) for t in range(4)]
    turns += [(7, 1, "assistant", "word1 again"), (10, 0, "user", "tone again"), (None, 1, "assistant", "and tone1"), (None, 1, "assistant", "and"), (5, None, "assistant", "tone"), (3, 0, "user", None), (3, 1, "assistant", "word1"), (4, 0, "user", "and"), (4, 1, "assistant", " \n"), (6, 1, "assistant", "zzzqqq"), (8, 0, "system", "A " * 2500 + "word1"), (8, 1, "assistant", "a"), (9, 1, None, "and")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = _all_pairs(turns)
    assert len({p for p, _ in want}) == len({q for _, q in want}) == 16
    found = catalog.queries()["t69_gram_cosine"](spark, str(tmp_path)).collect()
    assert {((r.a_conv, r.a_turn), (r.c_conv, r.c_turn)): r.cosine for r in found} == pytest.approx(want, abs=1e-6)
    assert len(found) == len(want) and all(r.matched == ((r.a_conv, r.a_turn) == (r.c_conv, r.c_turn)) for r in found)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = "a_conv", "a_turn", "c_conv", "c_turn", "matched", "cosine"
    assert sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()['t69_gram_cosine']})").fetchall()) == sorted(tuple(r[c] for c in columns) for r in found)
