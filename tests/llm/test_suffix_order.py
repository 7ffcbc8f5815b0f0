"""The order of all suffixes against brute force, and against the search that the query uses."""

import random

import pytest
from pyspark.sql import functions as F

from gyre.llm.suffix import remove_repeated_bytes
from gyre.llm.suffix_order import repeated_starts, spans


def starts(texts, length):
    where = {}
    for i, t in enumerate(texts):
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            where.setdefault(t[p : p + length], []).append((i, p))
    return sorted(x for places in where.values() if len(places) > 1 for x in places)


@pytest.mark.parametrize("length", [9, 11, 25])  # names of 3 and 9 bytes; all ways that the last names overlap
def test_against_brute_force(spark, length):
    r = random.Random(length)
    texts = ["".join(r.choices("ab é", k=r.randint(0, 90))) for _ in range(25)] + ["ab" * 60, "", None, "x" * 30]
    texts += [texts[0], texts[3][:50] + "zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3)
    assert sorted(tuple(x) for x in repeated_starts(df, length).collect()) == starts(texts, length)


def test_the_search_gives_the_same(spark):
    """At 400 bytes, on documents with shared passages."""
    r = random.Random(2)
    prose = lambda n: " ".join(r.choice(("lorem", "ipsum", "dolor", "ünd")) + str(r.randint(0, 90)) for _ in range(n))
    shared = [prose(60), prose(90)]
    texts = [prose(r.randint(10, 80)) + " " + (r.choice(shared) if i % 2 else "") + " " + prose(20) for i in range(12)] + ["ab" * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(2)
    found = repeated_starts(df, 400).groupBy("doc").agg(F.sort_array(F.collect_list("p")).alias("p")).select("doc", spans(F.col("p"), 400).alias("s"))
    wanted = {x.doc: [tuple(s) for s in x.spans] for x in remove_repeated_bytes(df, id_col="doc").where("n_removed > 0").collect()}
    assert wanted and {x.doc: [tuple(s) for s in x.s] for x in found.collect()} == wanted


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        repeated_starts(spark.createDataFrame([(1, "x")], "doc long, text string"), 8)
