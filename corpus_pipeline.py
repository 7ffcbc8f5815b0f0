"""A cleaning pipeline over documents: quality rules, near-duplicates, repeated passages, benchmark items, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept, and returns the columns of documents: others that docs has are dropped.
The stages read sizes and write scratch tables while they plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.decontaminate import contaminated
from gyre.llm.minhash import near_duplicates
from gyre.llm.packing import pack
from gyre.llm.quality import judge
from gyre.llm.suffix import remove_repeated_passages
from gyre.llm.tokens import vocabulary
from gyre.session import materialize, settled, sized, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a run that counts as repeated: passages of over 50 words hold one.
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict.

    Null, empty and blank texts fail; a null host is judged by the document
    alone; repeated rows count each and have the same verdict.
    """
    return judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id. Five-word shingles, similarity 0.8.

    Each row counts for itself, under a key of its own: of repeated rows and of
    rows without an id that are alike exactly one stays, and one with an id
    goes before those without.
    """
    keyed = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "keyed")
    found = near_duplicates(keyed.select("_row", "text"), "_row").select("_row", "component_id")
    found = materialize(found.join(keyed.select("_row", "doc_id"), "_row"), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row"))
    stays = found.groupBy("component_id").agg(first.alias("first")).select("first._row")
    gone = materialize(found.join(stays, "_row", "left_anti").select("_row"), "duplicates")
    return keyed.join(sized(gone), "_row", "left_anti").select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that runs of PASSAGE_WORDS words cover which start anywhere else too.

    Whole words go, with what stands between them, so that no character is
    cut; a document of which no word is left goes, and so do null and blank
    texts. Repeated rows and copies under other ids hold each other's runs.
    """
    found = remove_repeated_passages(docs.select(*COLUMNS), words=PASSAGE_WORDS)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = found.withColumn("text", text).where("n_words > n_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; equal texts share a verdict, null and blank texts hold none and stay."""
    found = materialize(contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("text_md5").distinct(), "contaminated")
    own = docs.select(*COLUMNS).withColumn("text_md5", F.unhex(F.md5("text")))
    return own.join(sized(found), "text_md5", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens, with their ids (four bytes each, little-endian).

    Null and empty texts are the final id alone; repeated rows are pieces of their own.
    """
    return pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: SQL expresses neither the tokens nor the packing; tests/llm/test_pipeline.py compares all five stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's scratch tables go when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
