"""Stems, full text search, longest prefixes, broken responses, rounds of retrieval, graphs and stores against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.functions.english import lexeme, stem
from gyre.functions.responses import first_object
from gyre.operators.fulltext import closeness, full_text_search, inverted_index, positions_of
from gyre.operators.graph_index import graph_index, search_graph
from gyre.operators.loops import iterative_retrieval, word_retriever
from gyre.operators.prefixes import longest_prefixes
from gyre.sources.store import Conflict, Store

# Words and stems of the public definition's examples.
STEMS = """caresses caress ponies poni ties tie cats cat agreed agre plastered plaster motoring motor sized size hopping hop falling fall hissing hiss failing fail filing file
happy happi relational relat conditional condit digitizer digit radicalli radic vileli vile operator oper feudalism feudal hopefulness hope sensibiliti sensibl triplicate triplic
formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt communism communism effective effect
probate probat rate rate cease ceas controll control roll roll consigned consign consistency consist knackeries knackeri knightly knight generously generous dying die news news
inning inning skies sky by by say say cry cri youth youth boyish boyish using use succeed succeed""".split()


def test_stems():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert lexeme("the") is None and lexeme("théorie") == "théori" and stem("x1") == "x1"


def test_closeness_is_that_of_all_pairs():
    r = random.Random(2)
    for _ in range(30):
        places = r.sample(range(1, 600), 40)
        lists = [np.array(sorted(places[k::4])) for k in range(4)]
        left = 1.0
        for i in range(4):
            for j in range(i):
                for a in lists[i]:
                    for b in lists[j]:
                        d = abs(int(a) - int(b))
                        left *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
        assert abs(closeness(lists) - (1 - left)) < 1e-9
    assert abs(closeness([np.array([3, 9])]) - 0.1 * 1.25 / 1.64493406685) < 1e-12


def test_full_text_search(spark):
    """All lexemes must occur, in any form; the nearer ranks higher; stop words, nulls and unknown words."""
    docs = [(1, "The cats were running in gardens"), (2, "A cat. " + "word " * 60 + "It runs in a garden"), (3, "cat garden"), (4, None), (5, ""), (6, "Running cat, garden cat")]
    index = inverted_index(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id")
    asked = spark.createDataFrame([(10, "cats run the gardens"), (11, "the of and"), (12, "cat unknownword"), (13, "CAT"), (14, None)], "qid int, text string")
    got = full_text_search(index, asked, "doc_id", "qid", k=2).orderBy("qid", "rank").collect()
    assert [(x.qid, x.doc_id) for x in got] == [(10, 6), (10, 1), (13, 6), (13, 1)]
    assert {x.doc_id for x in full_text_search(index, asked, "doc_id", "qid").where("qid = 10").collect()} == {1, 2, 6}
    assert positions_of("The cats, the cat") == {"cat": [2, 4]}


def test_longest_prefixes(spark):
    r = random.Random(4)
    words = ["a", "b", "ab"]
    stored = [(i, [r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 6, 7, 12, 13, 40]))]) for i in range(80)] + [(900, []), (901, None)]
    asked = [(i, [r.choice(words) for _ in range(r.randint(0, 8))]) for i in range(200)] + [(300 + i, w + ["c"]) for i, w in stored[:40]] + [(500, None)]
    got = {x.id: (x.size, x.entry) for x in longest_prefixes(*(spark.createDataFrame(t, "id long, w array<string>") for t in (asked, stored)), "id", "w").collect()}
    want = {}
    for i, w in asked:
        fits = [(len(s), -n) for n, s in stored if s and w and w[: len(s)] == s]
        if fits:
            want[i] = (max(fits)[0], -max(fits)[1])
    assert got == want and len(want) > 100
    empty = spark.createDataFrame([], "id long, w array<string>")
    assert longest_prefixes(empty, empty, "id", "w").count() == 0


def test_first_object(spark):
    cases = ['{"a": 1}', 'x {"a": {"b": "}{"}} {"c": 2}', '```json\n{"a": "q\\"}", "b": [{}]}\n```', '{"a": 1', "none", "", '{"s": "\\\\"} tail }', '{"a": "open }', "{} {}", '" {"a": "é}"} "', "x\\{\"a\": 1}", None]
    got = [x.o for x in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", first_object(F.col("t")).alias("o")).orderBy("i").collect()]
    for case, o in zip(cases, got, strict=True):
        want = None
        if case and "{" in case:
            try:
                want = case[case.index("{") :][: json.JSONDecoder().raw_decode(case[case.index("{") :])[1]]
            except ValueError:
                want = None
        assert o == want, case


def test_rounds_of_retrieval(spark):
    """A question with enough results stops; one without asks in other words; at most three rounds."""
    docs = [(i, f"green apple tree {i}") for i in range(4)] + [(10, "rephrase manual"), (11, "related reading")]
    index = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    asked = spark.createDataFrame([(1, "green apple"), (2, "purple stone"), (3, ""), (4, "tree 2 blue lake sea sky")], "q long, text string")
    got = {x.q: (x.rounds, x.found, round(x.relevance, 3)) for x in iterative_retrieval(asked, ["q"], "text", word_retriever(index, "doc_id", 8), "doc_id", ("", "rephrase ", "related "), 3, 0.6).collect()}
    assert got == {1: (1, 4, 1.0), 2: (3, 2, 0.0), 3: (3, 2, 0.0), 4: (3, 6, round((4 / 6 + 3 * 2 / 6 + 0) / 5, 3))}


@pytest.mark.parametrize("shard", [20_000, 300])
def test_walks_find_what_is_near(spark, shard):
    """Recall against all rows, also with many shards; every row with a vector is in the index; repeated and zero vectors."""
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 24)).astype(np.float32)
    v[100:140] = v[5]
    v[141] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "vec_id long, embedding array<float>")
    index = graph_index(rows, "vec_id", "embedding", shard=shard).persist()
    assert sorted(x.vec_id for x in index.select("vec_id").collect()) == list(range(1500))
    assert index.select("shard").distinct().count() == (1 if shard > 1500 else 5)
    asked = rows.where("vec_id % 50 = 7 AND vec_id <> 107").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = {}
    for x in search_graph(asked, index, 10, "vec_id", "embedding").collect():
        found.setdefault(x.qid, set()).add(x.vec_id)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    hits = [len(found[q] & set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist())) / 10 for q in range(7, 1500, 50) if q != 107]
    assert np.mean(hits) >= 0.9 and all(q in found[q] for q in found)


def test_store_shows_whole_commits_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    seen = lambda name: sorted(r.i for r in store.read(name).collect())
    assert store.state() == {}
    with pytest.raises(KeyError):
        store.read("a")
    store.commit(a=rows(1, 2), b=rows(10))
    broken = rows(3).select(F.raise_error(F.lit("no")).cast("int").alias("i"))
    with pytest.raises(Exception, match="no"):
        store.commit(a=rows(3), b=broken)
    assert (seen("a"), seen("b")) == ([1, 2], [10])
    store.commit(a=rows(4))
    assert (seen("a"), seen("b")) == ([1, 2, 4], [10])
    # two writers that saw the same state: the second one fails and changes nothing
    with pytest.raises(Conflict):
        store._write(2, {"a": []})
    assert seen("a") == [1, 2, 4]
    assert store.vacuum() >= 1 and seen("a") == [1, 2, 4] and store.vacuum() == 0
    store.delete(rows(1, 10, 10), "a", "b")
    assert (seen("a"), seen("b")) == ([2, 4], [])
    store.replace(a=rows(7))
    assert (seen("a"), seen("b")) == ([7], []) and store.vacuum() == 4


@pytest.mark.parametrize("half", [False, True])
def test_vector_files(spark, tmp_path, half):
    """Round trip by blocks and ranges; a lookup reads only the rows that are asked for; numpy reads the files."""
    from gyre.sources.vector_files import get_vectors, merged, read_vectors, write_vectors

    v = np.random.default_rng(4).normal(size=(1000, 16)).astype(np.float16 if half else np.float32)
    rows = spark.createDataFrame([(i * 3, [float(y) for y in x]) for i, x in enumerate(v)] + [(1, None), (None, [1.0] * 16), (2, [None] * 16)], "k long, e array<float>").repartition(3)
    path = f"file://{tmp_path}/v"
    index = write_vectors(rows, "k", "e", path, half, block=128)
    assert index.count() == 1000 and index.select("file").distinct().count() >= 8
    files = {p.name: np.load(p) for p in (tmp_path / "v").glob("*.npy")}
    assert sum(map(len, files.values())) == 1000 and max(map(len, files.values())) == 128
    place = {(x.file, x.row): x.key for x in index.collect()}
    for x in read_vectors(spark, path, 50).collect():
        assert np.array_equal(np.array(x.vector, v.dtype), v[place[x.file, x.row] // 3]) and np.array_equal(files[x.file][x.row], v[place[x.file, x.row] // 3])
    keys = spark.createDataFrame([(k,) for k in (0, 3, 3, 600, 2997, 5, -1)], "key long")
    got = get_vectors(keys, index, path, half, gap=0).collect()
    assert {x.key for x in got} == {0, 3, 600, 2997} and all(np.array_equal(np.array(x.vector, v.dtype), v[x.key // 3]) for x in got)
    assert sum(x.read for x in got) == 4 * 16 * v.itemsize
    assert merged([0, 10, 30], [10, 10, 5], 0) == [(0, 20), (30, 35)] and merged([0, 30], [10, 5], 20) == [(0, 35)]


def test_reranking_falls_back(spark):
    """By score, ties by the old rank; a query with a pair that has no score keeps its order."""
    from gyre.operators.retrieval import reranked

    rows = [(1, 10, 1, 0.2), (1, 11, 2, 0.9), (1, 12, 3, 0.2), (2, 20, 1, 0.1), (2, 21, 2, None), (2, 22, 3, 0.8)]
    hits = spark.createDataFrame(rows, "qid int, id int, rank int, s double")
    got = [(x.qid, x.id, x.score, x.place) for x in reranked(hits, "qid", "rank", F.col("s"), 2).orderBy("qid", "place").collect()]
    assert got == [(1, 11, 0.9, 1), (1, 10, 0.2, 2), (2, 20, 0.5, 1), (2, 21, 0.5, 2)]


def test_retrieval_shuffles_no_pairs(spark):
    """Each task sends on the k best rows of a question, however many share its words; ties by id, blocks of questions and rows without words."""
    from gyre.operators import loops

    docs = [(i, sorted({"all", f"w{i % 7}", f"v{i % 3}"})) for i in range(400)] + [(900, []), (901, None)]
    index = spark.createDataFrame(docs, "doc_id int, w array<string>").repartition(3)
    asked = spark.createDataFrame([(q, q % 2, f"All w{q % 7} V{q % 3} v{q % 3} none") for q in range(30)] + [(99, 0, ""), (98, 0, None)], "q long, t int, text string")
    score = lambda q, ws: len({"all", f"w{q % 7}", f"v{q % 3}"} & set(ws or []))
    want = {(q, q % 2, i, r) for q in range(30) for r, (_, i) in enumerate(sorted((-score(q, ws), i) for i, ws in docs if score(q, ws))[:4], 1)}
    for block, counts in ((4000, 1 << 20), (7, 10)):
        before, (loops.BLOCK, loops.COUNTS) = (loops.BLOCK, loops.COUNTS), (block, counts)
        try:
            found = loops.word_retriever(index, "doc_id", 4)(asked, ["q", "t"], "text")
            assert {(x.q, x.t, x.doc_id, x.rank) for x in found.collect()} == want
        finally:
            loops.BLOCK, loops.COUNTS = before
    hits = loops._best(asked.where("q < 30").select("q", "t", F.split(F.lower("text"), " ").alias("ws")), index.select(F.col("doc_id").cast("long").alias("doc_id"), "w"), ["q", "t"], "doc_id", 4)
    assert hits.count() <= 3 * 4 * 30


def test_prefixes_end_with_the_longest_entry(spark):
    """What stands behind the longest stored sequence is neither sent to Python nor read."""
    asked = spark.createDataFrame([(1, ["a", "b", "c", None]), (2, ["a", "x", None]), (3, [])], "id long, w array<string>")
    stored = spark.createDataFrame([(7, ["a"]), (8, ["a", "b"])], "id long, w array<string>")
    assert {x.id: (x.size, x.entry) for x in longest_prefixes(asked, stored, "id", "w").collect()} == {1: (2, 8), 2: (1, 7)}
