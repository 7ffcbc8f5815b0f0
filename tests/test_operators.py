"""Worked examples and invariants."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gyre.functions import text as X
from gyre.functions import vectors as V
from gyre.operators.graph import ego_nodes, induced_edges
from gyre.operators.retrieval import detect_grade, merge_hits, vote_grade
from gyre.plans import catalog
from gyre.sources import corpus
from gyre.plans import reading as P
from gyre.streaming.keyed import CircuitBreaker, MicroBatch, TokenBucket, token_bucket_stream

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("rows, expected", [
    ([(10, 0.61), (10, 0.59), (10, 0.58), (7, 0.40)], 10), ([(1, 0.40)] * 8 + [(10, 0.61), (10, 0.59), (10, 0.58)], 10),
    ([(3, 0.66), (8, 0.62), (8, 0.61), (8, 0.60)], 8), ([(1, 0.34)] * 20 + [(9, 0.55)], 9), ([(5, 0.10), (6, 0.20)], None), ([(None, 0.9)], None), ([(6, 0.72)], 6),
])
def test_detect_grade(spark, rows, expected):
    hits = spark.createDataFrame([(1, g, s, i) for i, (g, s) in enumerate(rows)], "qid int, grade int, similarity double, pos int")
    got = detect_grade(hits).first()
    assert (got and got.grade) == expected


@pytest.mark.parametrize("one, two, expected", [
    ([(6, 0.50), (6, 0.43), (6, 0.42), (6, 0.41)], [(3, 0.513), (3, 0.497), (3, 0.490), (6, 0.489)], 6),
    ([(2, 0.36)], [(11, 0.62), (11, 0.61), (11, 0.60), (5, 0.38)], 11), ([(6, 0.10)], [(3, 0.20)], None), ([], [(7, 0.55), (7, 0.54)], 7),
])
def test_vote_grade(spark, one, two, expected):
    rows = [(1, q, g, s, i) for q, hits in ((1, one), (2, two)) for i, (g, s) in enumerate(hits)]
    got = vote_grade(spark.createDataFrame(rows, "question int, qid int, grade int, similarity double, pos int")).first()
    assert (got and got.grade) == expected


def test_pooling(spark):
    hits = spark.createDataFrame([("a", 0.5, 0), ("a", 0.61, 1), ("b", 0.4, 2), ("c", 0.7, 3)], "p string, similarity double, pos int")
    assert [round(x.similarity, 2) for x in merge_hits(hits, ["p"], 2).collect()] == [0.7, 0.61]


@pytest.mark.parametrize("word, units", [("नमस्ते", "न म स्ते"), ("प्रकाश", "प्र का श"), ("विद्यार्थी", "वि द्या र्थी"), ("संश्लेषण", "सं श्ले ष ण"), ("का", "का")])
def test_aksharas(spark, word, units):
    assert value(spark, X.aksharas(F.lit(word), X.VIRAMAS["Devanagari"])) == units.split()


def test_syllables_and_scripts(spark):
    for word, n in {"cat": 1, "water": 2, "photosynthesis": 5, "the": 1, "make": 1, "123": 0}.items():
        assert value(spark, X.latin_syllables(F.lit(word))) == n
    assert value(spark, X.script(F.lit("नमस्ते world का"))) == "Devanagari" and value(spark, X.script(F.lit("12"))) == "Unknown"
    assert value(spark, X.sentence_count(F.lit("एक। दो। तीन"))) == 3


def test_cleaning_and_redaction(spark):
    assert value(spark, X.cleaned(F.lit("photosyn-\nthesis is\na   process\n\n\n\nNext "))) == "photosynthesis is a process\n\nNext"
    assert value(spark, X.redacted(F.lit("a@b.org 123-45-6789 password=hunter2hunter"))) == "[REDACTED_EMAIL] [REDACTED_SSN] [REDACTED_PASSWORD]"


def test_chunks():
    r = random.Random(2)
    text = "\n\n".join(" ".join(["Light helps the plant to make its own food."] * 12) for _ in range(9))
    for t, size, overlap in ((text, 1200, 200), ("x" * 5000, 1000, 100), ("".join(r.choice("ab. ") for _ in range(9000)), 700, 90)):
        chunks = list(X.chunks_of(t, size, overlap))
        assert all(120 <= len(c) <= size for c in chunks) and sum(map(len, chunks)) >= 0.95 * len(t.strip())
    assert list(X.chunks_of("  \n ")) == []
    with pytest.raises(ValueError):
        list(X.chunks_of("a", 10, 10))


def test_books(spark):
    codes = spark.createDataFrame([(c,) for c in "aeen1 fecu1 jesc1 lebo1 jhsc1 lubs1 mesc1 jxsc1 jesc jes1 jesc11".split()], "c string")
    got = codes.select(X.book_grade(F.col("c")), X.book_medium(F.col("c"))).collect()
    assert [tuple(x) for x in got] == [(1, "English"), (6, "English"), (10, "English"), (12, "English"), (10, "Hindi"), (12, "Urdu")] + [(None, None)] * 5
    page = 'if(pm=="jesc1"){<strong>Science</strong>} if(pm=="khch1"){<strong>Chemistry Part-I");\n} if (pm=="notacode"){<strong>No</strong>} if(pm=="jesc1"){<strong>Other</strong>}'
    rows = corpus.parse_catalog(spark.createDataFrame([(page,)], "html string")).collect()
    assert [(x.code, x.title, x.grade) for x in rows] == [("jesc1", "Science", 10), ("khch1", "Chemistry Part-I", 11)]


def test_first_title_over_pages(spark):
    pages = [(k, f'if(pm=="jesc1"){{<strong>Title {k}</strong>}}') for k in (3, 1, 2)]
    for order in (pages, pages[::-1]):
        rows = corpus.parse_catalog(spark.createDataFrame(order, "run int, html string").repartition(3), place_col="run").collect()
        assert [(x.code, x.title) for x in rows] == [("jesc1", "Title 1")]


def test_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [float("inf"), 0.0]), (4, [0.0, 0.0])], "i int, v array<float>")
    assert [x.i for x in df.where(V.finite(F.col("v"))).collect()] == [1, 4]
    assert [x.c for x in df.where("i in (1, 4)").select(V.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()] == [1.0, 0.0]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "a")], "source string, target string")
    nodes = ego_nodes(edges, spark.createDataFrame([("a",)], "key string"), 2)
    assert {(x.key, x.distance) for x in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert induced_edges(edges, nodes).count() == 2


def test_machines():
    b = TokenBucket(2, 10.0)
    assert [b.step(t) for t in (0, 0, 0, 0, 5, 5)] == [True, True, True, False, True, False]
    c = CircuitBreaker(failures_to_open=2, successes_to_close=1, timeout=10)
    assert [c.step(t, f) for t, f in ((0, 1), (1, 1), (2, 0), (11, 0), (12, 0))] == [True, True, False, True, True] and c.state == "closed"


def test_token_bucket_stream(spark, tmp_path):
    rows = [(k, float(i), k * 100 + i) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "key long, s double, id long")
    df.write.parquet(str(tmp_path / "in"))
    out = token_bucket_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "s", "id", 2, 10.0)
    q = out.writeStream.format("memory").queryName("buckets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(x.key, x.id): x.allowed for x in spark.table("buckets").collect()}
    for k in range(3):
        b = TokenBucket(2, 10.0)
        assert [got[k, k * 100 + i] for i in range(8)] == [b.step(float(i)) for i in range(8)]


def test_store(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("source in ('src1', 'src2')")
    content, chunks = corpus.store_documents(docs, str(tmp_path))
    corpus.store_documents(docs.where("source = 'src1'"), str(tmp_path))
    assert spark.read.parquet(content).count() == docs.count() and spark.read.parquet(chunks).where("length(chunk_text) < 120").isEmpty()
    assert corpus.delete_documents(spark.read.parquet(content), docs.where("source = 'src2'")).where("source = 'src2'").isEmpty()


def plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.8g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = catalog.oracle_sql()
    for name in sql:
        df = catalog.queries()[name](spark, SF)
        found = con.execute(sql[name])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names), name
        expected = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
        assert sorted(tuple(map(plain, r)) for r in df.collect()) == expected, name


def test_micro_batches():
    """A batch opens at the first item, after size items, and wait seconds after the batch's first."""
    b = MicroBatch(3, 10.0)
    assert [b.step(t) for t in (0, 1, 2, 3, 4, 13, 14)] == [True, False, False, True, False, True, False]


def test_sentences_kept_and_endings(spark):
    long = "This sentence has well over forty characters in it."
    assert value(spark, P._long_enough(F.lit(f"Short. {long} No."))) == [long]
    assert value(spark, P._long_enough(F.lit("Short."))) == ["Short."]
    assert value(spark, P._ended(F.lit("A whole sentence that is long enough. And"))) == "A whole sentence that is long enough."
    assert value(spark, P._ended(F.lit("Early. A very long rest without any end of its own"))) == "Early. A very long rest without any end of its own"
    assert value(spark, P._ended(F.lit("Done!"))) == "Done!"


def test_long_sentences_break_at_conjunctions(spark):
    words = " ".join(["word"] * 13)
    assert value(spark, P._broken(F.lit(f"{words} and {words}."))) == f"{words.capitalize()}. {words.capitalize()}."
    assert value(spark, P._broken(F.lit("one and two."))) == "one and two."


def test_clauses_start_as_the_sql_has_them(spark):
    words = " ".join(["word"] * 26)
    assert value(spark, P._broken(F.lit(f"{words} and ßab ΑΣ."))) == f"{words.capitalize()}. ẞab ασ."
    assert value(spark, P._broken(F.lit(f"{words} soß."))) == f"{words.capitalize()}. ẞ."
    assert value(spark, P._broken(F.lit(f"{words} ŉa."))) == f"{words.capitalize()} ŉa."


@pytest.mark.parametrize("word, n", [("make", 1), ("the", 1), ("water", 2), ("yes!", 1), ("...", 0), ("apple", 1)])
def test_syllables_with_final_e(spark, word, n):
    assert value(spark, P._syllables_e(F.lit(word))) == n


def test_reading_measures_of_null_and_empty_text(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    got = df.select(P._ended(F.col("text")).alias("a"), P._long_enough(F.col("text")).alias("b"), P._broken(F.col("text")).alias("c")).collect()
    assert got[1].a == "" and got[1].b == [""] and got[1].c == "." and got[0].a is None and got[0].c is None
