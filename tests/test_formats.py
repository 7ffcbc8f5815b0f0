"""Archives, DOCX files, uploads, Markdown, caches, chunk ends."""

import random

import pytest
from pyspark.sql import functions as F

from gyre.functions import answers as A
from gyre.functions import text as X
from gyre.sources import corpus
from gyre.streaming.keyed import FifoCache, TieredCache


def test_archives(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x/jesc101.pdf", b"one"), ("a", "jesc1ps.pdf", b"front"), ("b", "fehl102.pdf", b"two")], "book string, name string, content binary")
    packed = corpus.zipped(rows, "book", "name", "content")
    got = sorted((x.archive, x.code, x.chapter, bytes(x.content)) for x in corpus.members(packed).collect())
    assert got == [("a", "jesc1", 1, b"one"), ("b", "fehl1", 2, b"two")]
    for x in packed.collect():
        (tmp_path / f"{x.path}.zip").write_bytes(bytes(x.content))
    assert corpus.archive_members(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="over 10 bytes"):
        corpus.archive_members(spark, str(tmp_path), most_bytes=10).collect()


def test_docx(spark):
    rows = spark.createDataFrame([(1, "a <b>\n \nc & d"), (2, "")], "id long, text string")
    assert {x.path: x.text for x in corpus.docx_text(corpus.docx_of(rows, "id", "text")).collect()} == {"1": "a <b>\n\nc & d", "2": ""}


def test_uploads(spark):
    files = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.png", corpus.MOST_UPLOAD + 1), ("d.heic", corpus.MOST_UPLOAD)], "path string, length long")
    assert {x.path for x in corpus.allowed_uploads(files).collect()} == {"a.PDF", "d.heic"}


def test_markdown(spark):
    text = "# T\n\n**b** *i* `c`\n\n- x\n\n```py\nz\n```\n\n[l](u)\n\nplain"
    html = spark.range(1).select(corpus.markdown_html(F.lit(text)).alias("x")).first().x
    assert html == '<h1>T</h1><strong>b</strong> <em>i</em> <code>c</code><li>x</li><pre><code class="language-py">z\n</code></pre><p><a href="u">l</a></p><p>plain</p>'


def test_caches():
    fifo = FifoCache(2, 10.0)
    assert [fifo.step(t, k) for t, k in ((0, 1), (1, 1), (2, 2), (3, 3), (4, 1), (13, 3), (13, 1))] == [False, True, False, False, False, False, True]
    tiers = TieredCache(1, 2)
    assert [tiers.step(0, k) for k in (1, 1, 2, 1, 3, 2)] == [False, True, False, False, False, False]
    assert list(tiers.upper) == [2] and list(tiers.lower) == [3, 2]


def test_chunks_cover_the_text():
    """Every character is in a chunk, chunks overlap as asked, and stops are preferred to hard cuts."""
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choices(["word ", "a", ". ", "\n\n", "! "], k=r.randint(1, 400))).strip()
        chunks = list(X.chunks_of(text, 60, 15, 0))
        at = 0
        for c in chunks:
            at = text.index(c, max(0, at - 60))
        assert not text or (chunks and text.endswith(chunks[-1]) and text.startswith(chunks[0]))
        assert all(len(c) <= 60 for c in chunks)
    assert list(X.chunks_of("x" * 50 + ". " + "y" * 30, 60, 10, 1)) == ["x" * 50 + ".", ("x" * 9 + ". " + "y" * 30)]
    assert list(A.windows_of("one. two\nthree", 8, 2)) == ["one.", ".", "two", "o\nthree"] and list(A.windows_of("", 8, 2)) == []


@pytest.mark.parametrize("question, answer", [("What is 2 plus 3?", "5"), ("calculate (2+3)*4", "20"), ("10 divided by 4", "2.5"), ("2^10", "1024"), ("what is 7 over 0", None), ("why", None), ("1" * 60, None), ("((((1))))", None)])
def test_answers(question, answer):
    assert A.answered(question) == (answer and f"**{question}** = **{answer}**")


def test_two_numbers(spark):
    df = spark.createDataFrame([("What is 2 plus 3?",), ("4+5",), ("why",)], "q string").where(F.col("q").rlike(A.TWO_NUMBERS))
    assert [x.a for x in df.select(A.two_number_answer(F.col("q")).alias("a")).collect()] == ["**What is 2 plus 3?** = **5**", "**4+5** = **9**"]


def test_members_leave_in_large_frames():
    """A frame holds the members of many archives, up to a number and to bytes."""
    import io
    import zipfile

    import pandas as pd

    def archive(k):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in range(40):
                z.writestr(f"{k}/aesc1{n + 10}.pdf", b"x")
            z.writestr("aesc1ps.pdf", b"front")
        return out.getvalue()

    frames = [pd.DataFrame({"path": [str(k), str(k + 1)], "content": [archive(k), archive(k + 1)]}) for k in range(0, 60, 2)]
    got = list(corpus._unpacked(iter(frames), corpus.CHAPTER))
    assert [len(x) for x in got] == [1000, 1000, 400] and set(pd.concat(got).value_counts(["archive", "code"]).tolist()) == {40}
