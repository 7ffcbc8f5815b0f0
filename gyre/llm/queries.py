"""The thin queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyre.llm.chat import other_answers, preference_pairs, span_text
from gyre.llm.decontaminate import flag
from gyre.llm.langid import fit, held_out, predict
from gyre.llm.minhash import near_duplicates
from gyre.llm.negatives import hard_negatives
from gyre.llm.packing import pack
from gyre.llm.quality import judge
from gyre.llm.repair import damaged, joined_hash, repaired
from gyre.llm.signatures import similar_documents
from gyre.llm.sql import SQL
from gyre.llm.substring import remove_earlier_passages
from gyre.llm.suffix import remove_repeated_bytes
from gyre.llm.tokens import vocabulary
from gyre.llm.urls import judge_urls
from gyre.llm.warc import read_archives, write_archives
from gyre.session import materialize, table

# The rules of the URL query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return flag(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items", "similarity")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, carried=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed", "host_strict")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation (chosen) against itself with its last answer from a neighbour (rejected): what goes before is shared."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    # a table of its own: the variants are read for the pairs and for their turns
    variants = materialize(other_answers(turns), "variants")
    pairs = variants.select((-1 - F.col("conv_id")).alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "donor").distinct()
    made = preference_pairs(turns.unionByName(variants.drop("donor")), pairs)
    return made.select("chosen_id", "donor", "n_shared", "prompt", "chosen", "rejected", span_text(F.col("chosen_spans")).alias("chosen_spans"), span_text(F.col("rejected_spans")).alias("rejected_spans"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_archives(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_earlier_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = vocabulary("byte_bpe_multi_50k.tiktoken")
    model = fit(docs.where(~held_out(F.col("doc_id"))), pieces)
    return predict(docs.select("doc_id", "text"), model, pieces).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repaired(damaged(turns), turns.select("conv_id").distinct())
    lines = joined_hash(found.rows.select("conv_id", "place", F.concat_ws(":", "role", "text").alias("line")))
    out = found.conversations.join(lines.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", nothing).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op13_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontaminate, op2_quality, op3_preferences, op4_url_filters, op5_warc, op6_suffix_dedup, op7_substring_dedup, op8_language_id, op9_packing, op10_near_duplicates, op11_conversation_repair, op12_hard_negatives, op13_signature_join]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
