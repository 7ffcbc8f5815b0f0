"""URL rules, archives, chat, packing, language ID and decontamination on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gyre.llm.chat import preference_pairs
from gyre.llm.decontaminate import flag
from gyre.llm.langid import fit, held_out, predict
from gyre.llm.packing import pack
from gyre.llm.quality import judge
from gyre.llm.tokens import Encoder, vocabulary
from gyre.llm.urls import judge_urls
from gyre.llm.warc import read_archives, write_archives

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = [None, "", "http://", "https://A.Example.COM/en/x?q#f", "http://example.com/fr", "http://other.org/en/", "example.com/en/"]
    got = judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules)
    rows = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got.collect()}
    assert rows[3] == ("a.example.com", "/en/x", "example.com/en/", "block") and rows[4] == ("example.com", "/fr", "com/", "allow")
    assert all(rows[i] == ("", "", None, "allow") for i in (0, 1, 2, 6)) and rows[5][2:] == (None, "allow")


def test_archives(spark):
    rows = [(i, f"http://h/{i}", "same é" if i % 3 == 0 else f"page {i} " * (i % 50)) for i in range(300)] + [(None, None, "same é"), (900, "u\nv", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = read_archives(spark, write_archives(pages)).collect()
    assert len(got) == len(rows)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    first = {}
    for i in sorted(k for k in body if k is not None):
        first.setdefault(body[i], i)
    for x in got:
        if x.record_type == "revisit":
            assert x.refers_to == first[body[x.page_id]] < x.page_id and x.payload is None
        else:
            assert bytes(x.payload) == body[x.page_id] and x.payload_bytes == len(x.payload) and (x.page_id is None or first[body[x.page_id]] == x.page_id)


def test_chat(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "nö"), (2, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    x = preference_pairs(df, spark.createDataFrame([(0, 1), (0, 9)], "chosen_id long, rejected_id long")).collect()
    assert len(x) == 1 and x[0].n_shared == 1 and x[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert x[0].rejected[slice(*x[0].rejected_spans[0])] == "nö<|im_end|>"


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    docs = spark.read.parquet(DOCS).select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string"))
    rows = pack(docs, path, 256, with_ids=True, islands=2, epochs=1).collect()
    tokenizer = Tokenizer.from_file(path)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length * 4 == len(r.ids) <= 1024
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= -(-sum(r.length for r in rows) // 256) + 1
    own = [(r.start, np.frombuffer(r.ids, np.uint32).tolist()) for r in rows if r.doc_id == 3]
    text = docs.where("doc_id = 3").first().text
    assert sum((ids for _, ids in sorted(own)), []) == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_language_id(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(DOCS)
    model = fit(docs.where(~held_out(F.col("doc_id"))), path)
    out = predict(docs.where(held_out(F.col("doc_id"))), model, path)
    right = out.where("lang_pred = lang").count()
    assert right >= 0.9 * out.count() and out.where("score < 0 or score > 1").isEmpty()
    odd = predict(spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string"), model, path)
    assert {x.lang_pred for x in odd.collect()} == {"und"}


@pytest.mark.parametrize("words, expected", [(30, True), (12, False)])
def test_decontamination(spark, words, expected):
    item = " ".join(f"w{i}" for i in range(30))
    text = "before it " + " ".join(f"W{i}" for i in range(words)) + " after it all " * 5
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, n_items int")
    got = {x.doc_id: x.contaminated for x in flag(docs, spark.createDataFrame([(1, item), (None, None)], "item_id long, text string")).collect()}
    assert got == {1: expected, 2: False, 3: False}


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "a b c d e " * 4, "h"), (3, " ".join(f"word{i}" for i in range(20)), None)]
    got = {x.doc_id: x for x in judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1].kept and got[2].n_repeat_words == 20 and not got[2].kept and got[3].kept


def test_added_tokens():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer, encoder, end = Tokenizer.from_file(path), Encoder(path), "<|endoftext|>"
    texts = [f"end of doc {end} next", f"{end}next", f"doc {end}", f"a{end}{end} {end}\n\n{end}b  ", f" \n {end} \n x", end, "<|endoftext|", "<|ENDOFTEXT|>", f"<|endof{end}text|>"]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_added_tokens(spark):
    docs = spark.createDataFrame([(1, "end of doc <|endoftext|> next")], "doc_id long, text string")
    row = pack(docs, vocabulary("byte_bpe_50k.json"), 64, with_ids=True, islands=1, epochs=1).first()
    assert np.frombuffer(row.ids, np.uint32).tolist() == [437, 286, 2205, 220, 50256, 1306, 2] and row.length == 7
