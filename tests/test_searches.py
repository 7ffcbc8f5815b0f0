"""Searches by words and by vectors, against plain Python."""

import math
import random
from collections import Counter

from gyre.plans.catalog import queries


def test_keyword_rank(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, " ".join(r.choice(["Often", "also", "rare%d" % (i % 9), "x%d" % i, "ask"]) for _ in range(30))) for i in range(40)] + [(40, "nothing of it"), (41, None), (42, "")]
    items = ["often ALSO rare3", "x7 ask unseen"]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    asked = set(" ".join(items).lower().split())
    counts = {i: Counter(w for w in (t or "").lower().split() if w in asked) for i, t in docs}
    d = Counter(w for c in counts.values() for w in c)
    assert max(d.values()) > 30
    want = {i: sum(n * math.log(len(docs) / d[w]) for w, n in c.items()) for i, c in counts.items()}
    got = dict(map(tuple, queries()["t58_keyword_rank"](spark, str(tmp_path)).collect()))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want) and got[40] == got[41] == 0


def test_vector_queries(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 4) for i in range(100, 420)]  # no vec_id 0
    rows[150] = (250, [x * 2 for x in rows[0][1]], 1)  # as the query 100
    docs = [(i, "same" if i in (200, 300, 310) else f"text {i}") for i, _, _ in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    asked = [x for x in rows if x[0] % 100 == 0]
    scores = {q: sorted(((-cos(v, w), i, label) for i, w, label in rows)) for q, v, _ in asked}
    got = {n: queries()[n](spark, str(tmp_path)).collect() for n in ("k2_filtered_topk", "v13_semantic_cache", "f12_useful_similarity")}
    assert sorted((x.qid, x.rank, x.vec_id) for x in got["k2_filtered_topk"]) == [(q, k, i) for q in sorted(scores) for k, (_, i, _) in enumerate([x for x in scores[q] if x[2] in (1, 2)][:12], 1)]
    assert sorted((x.qid, x.vec_id) for x in got["f12_useful_similarity"]) == sorted((q, i) for q in scores for s, i, _ in scores[q] if -s >= 0.35)
    want = {}
    for q, found in scores.items():
        best = min((x for x in found if x[1] != q and -x[0] >= 0.92), default=None)
        want |= {q: (best[1], "semantic")} if best else {}
    want |= {200: (300, "exact"), 300: (200, "exact")}
    assert want[100] == (250, "semantic")
    assert {x.qid: (x.vec_id, x.hit) for x in got["v13_semantic_cache"]} == want
