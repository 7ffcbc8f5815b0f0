"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all operators."""

import os
import random
import struct
from collections import Counter

import pytest

from gyre.llm.chat import other_answers, preference_pairs
from gyre.llm.decontaminate import flag
from gyre.llm.langid import fit, predict
from gyre.llm.minhash import near_duplicates
from gyre.llm.packing import pack
from gyre.llm.quality import judge
from gyre.llm.substring import remove_earlier_passages
from gyre.llm.suffix import remove_repeated_bytes
from gyre.llm.tokens import vocabulary
from gyre.llm.urls import judge_urls
from gyre.llm.warc import read_archives, write_archives

SCHEMA = "doc_id long, text string, source string, lang string, n_words long, kept boolean, spans string, component_id string, verdict string, similarity string, lang_pred string"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(90))
ROWS = [
    (1, PASSAGE, "a", "en"),
    (2, PASSAGE, None, "en"),
    (2, PASSAGE, None, "en"),
    (3, None, "a", None),
    (4, "", "a", "de"),
    (5, " \n\t", None, "de"),
    (None, "one two three", "a", "en"),
    (None, None, None, None),
    (6, LONG, "b", "en"),
    (7, "0123 456", "b", "de"),
]
VOCABULARY = vocabulary("byte_bpe_multi_50k.tiktoken")
BPE = vocabulary("byte_bpe_50k.json")
has_vocabulary = pytest.mark.skipif(not os.path.exists(BPE), reason="no vocabulary files")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 99, None, "x", "x", "x", "x", "x") for r in ROWS], SCHEMA)


def ids(df, column="doc_id"):
    return Counter(r[0] for r in df.select(column).collect())


WANTED = Counter(r[0] for r in ROWS)


def test_quality(spark, docs):
    out = judge(docs)
    assert ids(out) == WANTED and len(set(out.columns)) == len(out.columns)
    by = {(r.doc_id, r.text): r for r in out.collect()}
    assert by[(6, LONG)].n_words == 30_000 and by[(6, LONG)].kept
    assert not any(by[k].kept or by[k].n_words for k in ((3, None), (4, ""), (5, " \n\t"), (None, None)))
    assert judge(docs.where("false")).count() == 0


def test_near_duplicates(spark, docs):
    out = near_duplicates(docs)
    found = {r.doc_id: r for r in out.collect()}
    assert ids(out) == WANTED
    assert (found[2].component_id, found[2].kept, found[1].kept) == (1, False, True)
    assert all(found[i].component_id == i and found[i].kept for i in (3, 4, 5, 6, 7))
    assert near_duplicates(docs.where("false")).count() == 0


def test_suffix(spark, docs):
    out = remove_repeated_bytes(docs, length=100)
    assert ids(out) == WANTED and len(set(out.columns)) == len(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert bytes(by[1].kept) == bytes(by[2].kept) == b"" and by[1].n_removed == len(PASSAGE)
    assert bytes(by[6].kept).decode() == LONG and by[3].n_bytes == by[4].n_bytes == 0
    assert remove_repeated_bytes(docs.where("false"), length=100).count() == 0


def test_substring(spark, docs):
    out = remove_earlier_passages(docs)
    assert ids(out) == WANTED and len(set(out.columns)) == len(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].n_removed == 0 and by[2].n_removed == 90 and by[2].kept == "" and by[6].n_removed == 0
    assert (by[3].n_words, by[4].n_words, by[5].n_words) == (0, 0, 0)
    assert remove_earlier_passages(docs.where("false")).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (4, " ")], "item_id long, text string")
    out = flag(docs, items)
    assert ids(out) == WANTED and len(set(out.columns)) == len(out.columns)
    assert {r.doc_id for r in out.where("contaminated").collect()} == {1, 2}
    assert {r.similarity for r in out.where("contaminated").collect()} == {1.0}
    assert not flag(docs, items.where("false")).where("contaminated").count() and flag(docs.where("false"), items).count() == 0


@has_vocabulary
def test_language(spark, docs):
    model = fit(docs, VOCABULARY)
    out = predict(docs, model, VOCABULARY)
    assert ids(out) == WANTED and len(set(out.columns)) == len(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == by[7].lang_pred == "und" and by[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in by.values())
    assert {r.lang_pred for r in predict(docs, fit(docs.where("false"), VOCABULARY), VOCABULARY).collect()} == {"und"}
    assert predict(docs.where("false"), model, VOCABULARY).count() == 0


@has_vocabulary
def test_packing(spark, docs):
    out = pack(docs, BPE).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == WANTED
    assert sum(r.length for r in out if r.doc_id == 4) == 1
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack(docs.where("false"), BPE).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x", "z"), (1, "http://A.com/x", "z"), (None, None, None), (2, "", "z"), (3, "a.com/x", "z"), (4, "http://a.com/" + "y" * 100_000, "z")], "page_id long, url string, host string")
    rules = spark.createDataFrame([("a.com", "/x", "block"), (None, "/", "block"), ("a.com", None, "allow")], "host string, path string, verdict string")
    out = judge_urls(pages, rules)
    assert ids(out, "page_id") == Counter([1, 1, None, 2, 3, 4]) and len(set(out.columns)) == len(out.columns)
    assert Counter((r.page_id, r.rule, r.verdict) for r in out.collect())[(1, "a.com/x", "block")] == 2
    assert {r.verdict for r in judge_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert judge_urls(pages.where("false"), rules).count() == 0


def test_archives(spark):
    pages = spark.createDataFrame([(2, "u", "same", "x"), (1, None, "same", "x"), (None, "u", "same", "x"), (3, "a\r\nb", None, "x"), (4, "", "", "x"), (5, "u", "z" * 3_000_000, "x")], "page_id long, url string, html string, payload string")
    out = {r.page_id: r for r in read_archives(spark, write_archives(pages)).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in out.items()} == {
        1: ("response", None, 4), 2: ("revisit", 1, 4), None: ("response", None, 4), 3: ("response", None, 0), 4: ("revisit", 3, 0), 5: ("response", None, 3_000_000),
    }
    assert read_archives(spark, write_archives(pages.where("false"))).count() == 0


def test_preferences(spark):
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, None, "a"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, 0, "user", "q"), (2, None, "user", "q"), (2, None, "user", "q")], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1, "k"), (0, 1, "k"), (2, 2, "k"), (2, 9, "k"), (None, 0, "k")], "chosen_id long, rejected_id long, prompt string")
    out = {(r.chosen_id, r.rejected_id): r for r in preference_pairs(turns, pairs).collect()}
    assert set(out) == {(0, 1), (2, 2)} and out[(0, 1)].n_shared == 1 and out[(2, 2)].n_shared == 2 and out[(2, 2)].chosen == ""
    assert preference_pairs(turns.where("false"), pairs).count() == 0


def test_no_text_is_long_enough(spark, docs):
    short = docs.where("doc_id in (3, 4, 5, 7)")
    assert Counter(r.n_removed for r in remove_repeated_bytes(short).collect()) == Counter([0] * 4)
    assert Counter(r.n_removed for r in remove_earlier_passages(short).collect()) == Counter([0] * 4)


def names(df):
    return [c.lower() for c in df.columns]


def test_clashing_names_are_kept_or_replaced(spark):
    """Columns that operators use inside stay as they are; those with an output's name, in any case, are replaced."""
    docs = spark.createDataFrame([(1, PASSAGE, "h", "x", 5, "m", True), (2, None, None, "y", 6, None, False)], "doc_id long, text string, source string, _host string, N_Words int, text_md5 string, Contaminated boolean")
    out = judge(docs)
    assert len(set(names(out))) == len(out.columns) and {(r.doc_id, r._host, r.text_md5) for r in out.collect()} == {(1, "x", "m"), (2, "y", None)}
    assert {r.doc_id: r.n_words for r in out.collect()} == {1: 90, 2: 0}
    out = flag(docs, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    assert names(out).count("contaminated") == 1 and {(r.doc_id, r.text_md5, r.contaminated) for r in out.collect()} == {(1, "m", True), (2, None, False)}
    pages = spark.createDataFrame([(1, "http://a.com/x", "q", "r"), (2, None, "s", None)], "page_id long, url string, by_rule string, HOST string")
    out = judge_urls(pages, spark.createDataFrame([("a.com", "/", "block")], "host string, path string, verdict string"))
    assert names(out).count("host") == 1 and {(r.page_id, r.by_rule, r.host, r.verdict) for r in out.collect()} == {(1, "q", "a.com", "block"), (2, "s", "", "allow")}


def test_equal_rules_of_different_verdicts_block(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/x", "allow"), ("A.com", "/x", "block"), ("a.com", "/x", "allow")], "host string, path string, verdict string")
    assert [r.verdict for r in judge_urls(pages, rules).collect()] == ["block"]


def test_archives_of_repeated_rows(spark):
    """Rows alike in id and payload are responses all, as none of them is before the others; files hold a dictionary, however few records they have."""
    pages = spark.createDataFrame([(1, "u", "same")] * 3 + [(2, "u", "same"), (3, "u", "")], "page_id long, url string, html string").repartition(2)
    files = write_archives(pages)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in read_archives(spark, files).collect()) == Counter({(1, "response", None): 3, (2, "revisit", 1): 1, (3, "response", None): 1})
    for row in files.collect():
        with open(row.file.removeprefix("file://"), "rb") as f:
            magic, size = struct.unpack("<II", f.read(8))
            assert magic == 0x184D2A5D and size > 0


def test_preferences_of_long_turns_and_no_pairs(spark):
    long = "x" * 300_000
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", long + str(t if t < 5 else c)) for c in (0, 1) for t in range(6)], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1, "k")], "chosen_id long, rejected_id long, a string")
    row = preference_pairs(turns, pairs).first()
    assert row.n_shared == 5 and row.a == "k" and len(row.prompt) == 5 * (len(long) + 1) + sum(len(f"<|im_start|>{r}\n<|im_end|>\n") for r in ("user", "assistant", "user", "assistant", "user"))
    assert row.chosen[slice(*row.chosen_spans[0])] == long + "0<|im_end|>" and row.rejected[slice(*row.rejected_spans[0])] == long + "1<|im_end|>"
    assert preference_pairs(turns, pairs.where("false")).count() == 0


def test_variants_share_what_goes_before_the_last_answer(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "more"), (1, 0, "user", "r"), (1, 1, "assistant", "b"), (2, 0, "user", "alone"), (5, 0, "assistant", "far"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted((r.donor, r.conv_id, r.turn, r.role, r.text) for r in other_answers(df).collect())
    assert got == [(0, -2, 0, "user", "r"), (0, -2, 1, "assistant", "a"), (1, -1, 0, "user", "q"), (1, -1, 1, "assistant", "b")]
    assert other_answers(df.where("false")).count() == 0


def test_decontamination_of_short_and_long_items(spark):
    """Items of fewer words than a shingle, and of hundreds, next to texts that hold them once or nearly."""
    r = random.Random(3)
    long = [f"t{i}q{r.randint(0, 9)}" for i in range(400)]
    items = [(1, "two words"), (2, "one"), (3, " ".join(long)), (4, " ".join(f"s{i}" for i in range(12)))]
    edited = [*long[:200], "other", *long[201:]]  # five of 396 shingles are lost
    docs = [(1, "has Two  Words in it"), (2, "has two other words"), (3, "x " + " ".join(edited) + " y"), (4, " ".join(long[:300])), (5, "one"), (6, "a " + " ".join(f"S{i}" for i in range(12)) + " b"), (7, " ".join(f"s{i}" for i in range(9)))]
    out = flag(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.n_items for r in out.collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1, 6: 1, 7: 0}
