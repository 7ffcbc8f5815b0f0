"""Language identification: sums over segmentations against brute force, the model's sample, held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.llm import langid as L
from gyre.llm.queries import op8_language_id
from gyre.llm.tokens import vocabulary

PIECES = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bcd", b" a", b"cdabcdabcdab", "é".encode(), "né".encode()]


@pytest.fixture(scope="module")
def model():
    v = L.Vocabulary(sorted(PIECES))
    p = np.random.default_rng(1).random((len(v), 3)) ** 4
    return v, p / p.sum(axis=0)


def place(v, piece):
    x = np.full(1, L._SEED)
    for b in piece:
        x = L._step(x, np.array([b], np.uint64))
    return int(np.searchsorted(v.codes, x[0]))


def every_way(v, p, word):
    """The sum over all segmentations, one by one."""
    if not word:
        return np.ones(p.shape[1])
    return sum((p[place(v, x)] * every_way(v, p, word[len(x) :]) for x in PIECES if word.startswith(x)), np.zeros(p.shape[1]))


@pytest.mark.parametrize("word", [b"x", b" abcdabcdab", b"cdabcdabcdabcdabcd", " néé".encode(), b"\xff\x00ab"])
def test_sums_against_brute_force(model, word):
    v, p = model
    wanted = np.log(every_way(v, p, word))
    assert np.allclose(L.forward(v, p, [word, word])[1], wanted) and np.allclose(L.forward_long(v, p, word), wanted)


def test_long_words_are_summed_whole(model):
    """No cut: both ways agree far beyond what a double holds unscaled, and beyond a block."""
    v, p = model
    word = random.Random(2).choices(b"abcdx", k=3000)
    assert np.allclose(L.forward(v, p, [bytes(word)])[0], L.forward_long(v, p, bytes(word)))
    longer = bytes(random.Random(3).choices(b"abcd", k=40_000))
    assert np.isfinite(L.forward_long(v, p, longer)).all()
    assert (L.forward_long(v, p, longer) < -10_000).all()


def test_training_counts(model):
    """One round: expected counts of pieces are those of all segmentations, weighted."""
    v, _ = model
    words = Counter({b"abcd": 3, b" ab": 1, b"ab" * 30: 2})
    p0 = np.full((len(v), 1), 1 / len(v))
    expected = np.full(len(v), 0.1)

    def ways(word):
        if not word:
            yield ()
        for x in PIECES:
            if word.startswith(x):
                for rest in ways(word[len(x) :]):
                    yield (x, *rest)

    for word, n in words.items():
        if len(word) < 10:
            found = [(w, np.prod([p0[place(v, x), 0] for x in w])) for w in ways(word)]
            for w, weight in found:
                for x in w:
                    expected[place(v, x)] += n * weight / sum(q for _, q in found)
    short = Counter({w: n for w, n in words.items() if len(w) < 10})
    assert np.allclose(L.train(v, {"a": short}, rounds=1)[:, 0], expected / expected.sum())
    assert np.isfinite(L.train(v, {"a": words}, rounds=2)).all()


def test_sample_does_not_depend_on_order_or_copies(spark):
    """A hot text takes one place; shuffled rows give the same sample; no language is lost."""
    rows = [(f"text number {i} of the many", "aa") for i in range(300)] + [("hot copy text", "bb")] * 2000 + [("x", None), (None, "aa"), ("12", "aa")]
    a = spark.createDataFrame(rows, "text string, lang string")
    random.Random(4).shuffle(rows)
    b = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    pick = lambda df: sorted((r.lang, r.text) for r in L.sample(df, "text", "lang", 100, 50).collect())
    assert pick(a) == pick(b)
    assert Counter(lang for lang, _ in pick(a)) == {"aa": 50, "bb": 1}


def test_model_is_repeatable(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one, two = (L.fit(df, path, rounds=1, most_rows=200) for df in (docs, docs.repartition(5).orderBy(F.rand(3))))
    assert one[0] == two[0] and (one[1] == two[1]).all()


def test_equal_probabilities_take_the_first_language(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    v = L.Vocabulary(L.read_pieces(path))
    flat = (["aa", "bb"], np.full((len(v), 2), 1 / len(v)))
    out = L.predict(spark.createDataFrame([(1, "word " * 3, "z")], "doc_id long, text string, LANG_PRED string"), flat, path).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("aa", 0.5)]


def test_query_on_held_out_documents(spark):
    """Accuracy by language on documents that the model has not seen, and what has no letter."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = op8_language_id(spark, sf).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    right, total = Counter(), Counter()
    for r in rows:
        if r.held_out and r.lang and r.lang_pred != "und":
            total[r.lang] += 1
            right[r.lang] += r.lang == r.lang_pred
    assert all(right[k] >= 0.9 * n for k, n in total.items()), (right, total)


def test_languages_without_spaces_are_learned(spark):
    """Words of hundreds of bytes count in overlapping stretches of whole characters; every labelled language with a letter is in the model."""
    r = random.Random(6)
    alphabets = {"zh": "的一是不了人我在有他这中大来上国", "th": "กขคงจชซญดตถทนบปผพมยรลวสห", "en": None}
    english = "the of and to in is was for that with river garden morning".split()
    text = lambda lang, n=200: " ".join(r.choices(english, k=n // 5)) if lang == "en" else "".join(r.choices(alphabets[lang], k=n))
    rows = [(lang, text(lang)) for lang in alphabets for _ in range(40)]
    pieces = vocabulary("byte_bpe_multi_50k.tiktoken")
    model = L.fit(spark.createDataFrame(rows, "lang string, text string"), pieces, rounds=1)
    assert model[0] == ["en", "th", "zh"]
    asked = spark.createDataFrame([(lang, text(lang, 90)) for lang in alphabets for _ in range(10)], "want string, text string")
    assert all(x.want == x.lang_pred for x in L.predict(asked, model, pieces).collect())
    for word in (("é" * 300).encode(), b"x" * 200, b"x" * 201, "ก".encode() * 500):
        parts = list(L.stretches(word))
        assert all(len(p) <= L.STRETCH and p.decode() for p in parts) and parts[0] == word[: len(parts[0])] and word.endswith(parts[-1])
        at = [word.find(p, max(0, k)) for k, p in enumerate(parts)]
        assert at[0] == 0 and b"".join([parts[0]]) and sum(map(len, parts)) >= len(word) + (len(parts) - 1) * L.SHARED


def test_predictions_against_a_plain_version(spark):
    """A small table: sums over all segmentations by recursion on each word, for each language, against lang_pred and score."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    pieces = L.read_pieces(path)
    rows = [("aa", "the cat and the dog went home"), ("aa", "a dog was there"), ("bb", "le chat et le chien"), ("bb", "un chien était là"), ("cc", "der Hund und die Katze")]
    model = L.fit(spark.createDataFrame(rows, "lang string, text string"), path)
    v = L.Vocabulary(pieces)
    probability = {p: model[1][place(v, p)].astype(np.float32).astype(float) for p in pieces if all(b in b" abcdefghiklmnorstuwzHKDTLU\xc3\xa9\xa0" for b in p)}

    def total(word):
        sums = [np.ones(3)] + [np.zeros(3) for _ in word]
        for i in range(len(word)):
            for n in range(1, min(v.longest, len(word) - i) + 1):
                if word[i : i + n] in probability:
                    sums[i + n] = sums[i + n] + sums[i] * probability[word[i : i + n]]
        return np.log(sums[-1])

    asked = ["the dog", "chien et chat", "die Katze und der Hund", "Le là", "", "12", None, "était " * 30]
    got = L.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, path).orderBy("doc_id").collect()
    for x, t in zip(got, asked, strict=True):
        if not t or not L.has_letter(t):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        logs = sum(total(b" " + w) for w in t.encode().split())
        scaled = (logs - logs.max()) * L.SCORED / max(L.SCORED, len(t.encode()))
        assert x.lang_pred == model[0][int(logs.argmax())] and abs(x.score - 1 / np.exp(scaled).sum()) < 1e-6
