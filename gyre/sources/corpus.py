"""Sources and sinks of a corpus: catalogs, standards, archives, documents with chunks, exports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.functions.text import book_grade, book_medium, catalog_titles, chunker
from gyre.session import ship

STANDARDS = T.StructType([
    T.StructField("grade_level", T.IntegerType()), T.StructField("subject", T.StringType()), T.StructField("topic", T.StringType()),
    T.StructField("learning_objectives", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())),
])


def parse_catalog(pages: DataFrame, html_col: str = "html", place_col: str | None = None) -> DataFrame:
    """(code, title, grade, medium) of catalog pages: the first title of each code, of the page with the least place_col, ordered by grade, medium, code."""
    ship(pages.sparkSession)

    @F.pandas_udf("array<struct<code:string,title:string>>")
    def titles(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [{"code": c, "title": t} for c, t in catalog_titles(h or "")])

    found = pages.select((F.col(place_col) if place_col else F.lit(0)).alias("page"), F.posexplode(titles(F.col(html_col))).alias("n", "book"))
    rows = found.groupBy("book.code").agg(F.min(F.struct("page", "n", "book.title"))["title"].alias("title"))
    return rows.select("code", "title", book_grade(F.col("code")).alias("grade"), book_medium(F.col("code")).alias("medium")).orderBy("grade", "medium", "code")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema="code string, title string, grade int, medium string", mode="FAILFAST")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The books of catalogs that are one JSON document each, with a list of books."""
    book = "struct<code:string,title:string,grade:int,medium:string>"
    return spark.read.json(path, schema=f"books array<{book}>", multiLine=True, mode="FAILFAST").select(F.inline("books"))


def write_catalog(books: DataFrame, path: str) -> None:
    """One sorted file, for readable differences: a catalog has hundreds of rows."""
    books.orderBy("grade", "medium", "code").coalesce(1).write.mode("overwrite").json(path)


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STANDARDS).option("multiLine", True).option("mode", "FAILFAST").json(path)


def store_standards(standards: DataFrame, path: str) -> None:
    """Standards as a table by grade; grades that come again replace their own partitions."""
    standards.select(*STANDARDS.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grade_level").parquet(path)


def stored_standards(spark: SparkSession, path: str) -> DataFrame:
    """What store_standards wrote; filters on the grade read its partitions alone."""
    return spark.read.schema(STANDARDS).parquet(path)


#: Members, and bytes of them, that leave a task at once.
MOST_MEMBERS, MOST_HELD = 1000, 8 << 20
#: Names of the members that are chapters: a book's code and a number of two digits.
CHAPTER = r"([a-l][ehu][a-z]{2}\d)(\d{2})\.pdf$"


def archive_members(spark: SparkSession, path: str, pattern: str = CHAPTER, most_bytes: int = 256 << 20) -> DataFrame:
    """(archive, code, chapter, content) of the members of ZIP files under path whose names match.

    An archive is read whole by one task: one of over most_bytes raises an
    error that names it, so that none is left out unseen.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    fits = F.when(F.col("length") <= most_bytes, F.col("content")).otherwise(F.raise_error(F.concat(F.lit(f"over {most_bytes} bytes: "), "path")).cast("binary"))
    return members(files.select("path", fits.alias("content")), pattern)


def members(archives: DataFrame, pattern: str = CHAPTER) -> DataFrame:
    """(archive, code, chapter, content) of the members of ZIP archives (path, content) whose names match; others, such as front matter, are left out."""
    ship(archives.sparkSession)
    return archives.select("path", "content").mapInPandas(lambda frames: _unpacked(frames, pattern), "archive string, code string, chapter int, content binary")


def _unpacked(frames: Iterator[pd.DataFrame], pattern: str) -> Iterator[pd.DataFrame]:
    """The members of archives, many in a frame."""
    names = ["archive", "code", "chapter", "content"]
    found, held = [], 0
    for frame in frames:
        for name, content in zip(frame["path"], frame["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for member in z.namelist():
                    if m := re.search(pattern, member):
                        found.append((name, m[1], int(m[2]), z.read(member)))
                        held += len(found[-1][3])
                        if len(found) == MOST_MEMBERS or held >= MOST_HELD:
                            yield pd.DataFrame(found, columns=names)
                            found, held = [], 0
    if found:
        yield pd.DataFrame(found, columns=names)


def zipped(rows: DataFrame, group: str, name: str, content: str) -> DataFrame:
    """(path, content): a ZIP archive for each group, of its members (name, content), in the order of their names."""
    ship(rows.sparkSession)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, c in sorted(zip(frame[name], frame[content], strict=True)):
                z.writestr(n, c)
        return pd.DataFrame({"path": [str(key[0])], "content": [out.getvalue()]})

    return rows.select(F.col(group).cast("string").alias(group), name, content).groupBy(group).applyInPandas(pack, "path string, content binary")


def docx_of(rows: DataFrame, path: str, text: str) -> DataFrame:
    """(path, content): each text as a DOCX file with a paragraph a line."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        from xml.sax.saxutils import escape

        def one(value: str) -> bytes:
            lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape("".join(c for c in x if c >= " " or c == chr(9)))}</w:t></w:r></w:p>' for x in value.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
            return out.getvalue()

        return texts.map(one)

    return rows.select(F.col(path).cast("string").alias("path"), write(text).alias("content"))


# Endings of documents and pictures that are taken, and the most bytes.
UPLOADS = (".pdf", ".docx", ".txt", ".md", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp", ".gif", ".heic")
MOST_UPLOAD = 100 << 20


def allowed_uploads(files: DataFrame, suffixes: tuple[str, ...] = UPLOADS, most_bytes: int = MOST_UPLOAD) -> DataFrame:
    """The files (path, length) with an allowed ending, by path, without case, and not over most_bytes; content is never read for the others."""
    name = F.lower("path")
    ending = F.lit(False)
    for s in suffixes:
        ending = ending | name.endswith(s)
    return files.where(ending & (F.col("length") <= most_bytes))


def docx_text(files: DataFrame) -> DataFrame:
    """(path, text) of DOCX files (path, content): paragraphs that aren't blank, with a blank line between."""
    ship(files.sparkSession)

    @F.pandas_udf("string")
    def paragraphs(content: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def read(raw: bytes) -> str:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
            return "\n\n".join(x for x in lines if x.strip())

        return content.map(read)

    return files.select("path", paragraphs("content").alias("text"))


def store_documents(documents: DataFrame, path: str, size: int = 1200, overlap: int = 200) -> tuple[str, str]:
    """Write content and chunks as tables under path, partitioned by source; a source that comes again replaces its own partition."""
    spark = documents.sparkSession
    ship(spark)
    write = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/{name}")
    write(documents.select("doc_id", "text", "lang", "source"), "content")
    chunks = documents.select("doc_id", "source", F.posexplode(chunker(size, overlap)("text")).alias("chunk_index", "chunk_text"))
    write(chunks.withColumn("chunk_id", F.sha2(F.concat_ws("/", "doc_id", "chunk_index"), 256)), "chunks")
    return f"{path}/content", f"{path}/chunks"


def delete_documents(table: DataFrame, gone: DataFrame) -> DataFrame:
    """The table without the rows of documents in gone (doc_id)."""
    return table.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def as_markdown(responses: DataFrame, title: str, text: str) -> DataFrame:
    """A single column value: each response under its title."""
    return responses.select(F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.col(text), F.lit("\n")).alias("value"))


def markdown_html(text):
    """Code, headings, bold, italics, items, paragraphs and links of Markdown as HTML, by rules in this order."""
    rules = [
        (r"(?s)```(\w*)\n(.*?)```", r'<pre><code class="language-$1">$2</code></pre>'), ("`([^`]+)`", "<code>$1</code>"),
        *((rf"(?m)^{'#' * n} (.+)$", f"<h{n}>$1</h{n}>") for n in (3, 2, 1)), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"(?m)^- (.+)$", "<li>$1</li>"), (r"(?m)^\d+\. (.+)$", "<li>$1</li>"),
    ]
    for pattern, out in rules:
        text = F.regexp_replace(text, pattern, out)
    parts = F.filter(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r\x0b\x0c")) != "")
    html = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<"), p).otherwise(F.concat(F.lit("<p>"), p, F.lit("</p>")))), "")
    return F.regexp_replace(html, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
