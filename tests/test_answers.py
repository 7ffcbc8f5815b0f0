"""Answers and sources, arithmetic, windows of text and searches in blocks, on literals."""

import pytest
from pyspark.sql import functions as F

from gyre.functions import answers as A
from gyre.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("2+2", 4), (" 7 // 2", 3), ("2 ** 10", 1024), ("-(3 - 5) * 1.5", 3.0), ("7 % 4", 3), ("1 < 2", True)])
def test_evaluate(text, expected):
    assert A.evaluate(text) == expected


@pytest.mark.parametrize("text", ["", "x", "f(1)", "__import__('os')", "'a' * 3", "1 / 0", "9 ** 9999999", "[1]", "1 +", "True", "1 < 2 < 3"])
def test_evaluate_refuses(text):
    with pytest.raises(ValueError, match=".*"):
        A.evaluate(text)


@pytest.mark.parametrize(
    ("question", "expected"),
    [("2+2", "**2+2** = **4**"), ("What is 25 plus 75?", "**What is 25 plus 75?** = **100**"), ("100/4", "**100/4** = **25**"), ("2^3", "**2^3** = **8**"), ("1 divided by 3", "**1 divided by 3** = **0.333333**"), ("what is love", None), ("1/0", None), ("", None), ("1+" * 40 + "1", None)],
)
def test_answered(question, expected):
    assert A.answered(question) == expected


def test_grounding_and_match(spark):
    t, o = F.col("t"), F.col("o")
    assert one(spark, A.grounding(t, o), t="The cell divides", o="a cell grows") == pytest.approx(0.6)
    assert one(spark, A.grounding(t, o), t="the of", o="cell") == 0.5
    assert one(spark, A.grounding(t, o), t="cell", o=None) == 0.5
    assert one(spark, A.question_match(t, o), t="what is photosynthesis", o="photosynthesis makes sugar") == 1.0
    assert one(spark, A.question_match(t, o), t="what is it", o="sugar") == 0.8


def test_consistency(spark):
    t = F.col("t")
    assert one(spark, A.contradictions(t), t="It is always so, but Never here; yes and NO.") == 2
    assert one(spark, A.unsupported(t), t="Studies show that it is well-known that x.") == 2


def test_intent(spark):
    assert one(spark, A.intent(F.col("t")), t="Compare X versus Y") == ("comparative", pytest.approx(2 / 3))
    assert one(spark, A.intent(F.col("t")), t="hello") == ("conversational", 0.5)
    # a tie goes to the first intent
    assert one(spark, A.intent(F.col("t")), t="define and explain").intent == "factual"


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH" + "12345678"
    assert one(spark, A.partly_shown(F.col("t")), t=f"key {key}, 123-45-6789.") == "key AKIA...5678[REDACTED], 123-...6789[REDACTED]."
    assert one(spark, A.partly_shown(F.col("t")), t=None) is None


SAMPLES = [
    ("aws_key", "AKIA" + "B" * 16, "critical"), ("aws_key", "aws_secret_access_key=" + "a" * 40, "critical"), ("api_key", 'api_key: "' + "k" * 20, "high"), ("api_key", "Bearer abc.def", "high"),
    ("api_key", "sk-" + "a" * 48, "critical"), ("api_key", "ghp_" + "a" * 36, "critical"), ("api_key", "gho_" + "a" * 36, "critical"), ("password", "pwd=hunter2hunter2", "critical"), ("password", "secret: abcdefgh", "high"),
    ("token", 'token = "' + "0a" * 12, "high"), ("token", "eyJa.eyJb.c", "high"), ("private_key", "-----BEGIN RSA PRIVATE KEY-----", "critical"), ("private_key", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "critical"),
    ("database_url", "redis://h:1/0", "critical"), ("database_url", "database_url=sqlite", "critical"), ("credit_card", "4" + "1" * 15, "critical"), ("ssn", "123-45-6789", "critical"), ("email", "a.b@c.org", "medium"), ("phone", "(555) 123-4567", "medium"),
]


@pytest.mark.parametrize(("kind", "value", "risk"), SAMPLES)
def test_each_secret(kind, value, risk):
    # the characters before it count, not their bytes
    found = A.secrets_of(f"é: {value} ")
    start = 3 + (value.startswith("("))  # a word boundary stands before the digits only
    assert (kind, value[start - 3 :], start, 3 + len(value), risk) in found
    assert value not in A.redacted_of(f"é: {value} ")


def test_secret_queries(spark, tmp_path):
    from gyre.plans.catalog import queries

    texts = ["see token = \"04dbebab04dbebab04dbebab\" ok", "mail a.b@c.org", "card 4111111111111111", None, "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {q: sorted(map(tuple, queries()[q](spark, str(tmp_path)).collect())) for q in ("t41_secret_scan", "t42_partly_redacted", "t44_input_check")}
    assert rows["t41_secret_scan"] == [(0, "token", texts[0][4:-4], 4, 37, "high"), (1, "email", "a.b@c.org", 5, 14, "medium"), (2, "credit_card", "4111111111111111", 5, 21, "critical")]
    assert [r[1] for r in rows["t42_partly_redacted"]] == ['see toke...ebab[REDACTED]" ok', "mail a.b@....org[REDACTED]", "card 4111...1111[REDACTED]", None, "nothing"]
    assert [r[1:] for r in rows["t44_input_check"]] == [("low", True), ("low", True), ("critical", False), ("low", True), ("low", True)]


def test_overlapping_secrets():
    # a JSON web token as a token's value: two matches, one secret
    own = "token=eyJaaaaaaaaaa.eyJbbbbbbbb.cccc"
    assert len(A.secrets_of(own)) == 2 and A.redacted_of(f"x {own} y") == "x toke...cccc[REDACTED] y"


def test_prose(spark):
    assert one(spark, A.prose_of_latex(F.col("t")), t="See \\textbf{this} [1], [2]. % note\nFig. 3 shows $x$") == "See this . shows x"


def test_windows():
    text = "One two. " * 200
    found = list(A.windows_of(text, 100, 20))
    assert all(len(w) <= 100 for w in found) and found[0].endswith(".") and "".join(found)
    # a stop just behind the start doesn't keep the windows from moving on
    assert list(A.windows_of(". " + "x" * 300, 100, 50))
    assert list(A.windows_of("", 10, 2)) == list(A.windows_of("  ", 10, 2)) == []


def test_token_windows(spark):
    tokens = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    found = spark.range(1).select(A.token_windows(tokens, 4, 1).alias("w")).first().w
    assert [list(map(int, w)) for w in found] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]
    assert spark.range(1).select(A.token_windows(F.array().cast("array<string>"), 4, 1).alias("w")).first().w == []


def test_nearest_in_blocks(spark):
    rows = [(i, [float((i * 7) % 11), float(i % 5), 1.0]) for i in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = e.where("vec_id < 10").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    assert sorted(V.nearest(q, e, 3, most_queries=3).collect()) == sorted(V.nearest(q, e, 3).collect())
    assert V.nearest(q.where("false"), e, 3).count() == 0


def test_next_documents_by_runs(spark, tmp_path):
    """Each document with the next five ids, across ends of runs and gaps, with empty and null texts and ids below 0; no join."""
    from gyre.plans.catalog import queries

    docs = [(i, f"Common w{i % 5} v{i % 3} v{i % 3}") for i in [*range(-70, -60), *range(55, 70), 72, 90, 125, 128, 133, 134]] + [(71, ""), (73, None), (None, "common")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {i: None if t is None else set(t.lower().split()) for i, t in docs if i is not None}
    share = lambda a, b: 1.0 if a is None or b is None else min(1.0, 2 * len(a & b) / max(1, len(a)))
    want = {i: [share(s, sets[j]) for j in range(i + 1, i + 6) if j in sets] for i, s in sets.items()}
    found = queries()["t55_relevance"](spark, str(tmp_path))
    got = {x.doc_id: x.relevance for x in found.collect()}
    assert got.keys() == {i for i, x in want.items() if x} and all(abs(got[i] - sum(want[i]) / len(want[i])) < 1e-6 for i in got)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_taken_once(spark, tmp_path):
    """A plan takes a text's words, and its neutral wording, once, however often what follows names them."""
    from gyre.plans.catalog import queries

    spark.createDataFrame([(i, "Red apples are red", "en") for i in range(3)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda name: queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan("t39_three_passes").count("split(") == 2 and plan("t36_question_match").count("split(") == 2
    assert plan("t59_regional_wording").count("backward class,") == 1
