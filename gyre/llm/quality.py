"""Quality rules for documents, and verdicts on hosts from the rules' failures.

Each document is measured by itself. Failures are then counted by host; a beta
prior fitted to all hosts' rates (method of moments) shrinks each host's rate,
so that a host with a few documents isn't judged by chance. Documents of a host
whose shrunk rate reaches a limit are kept only if they pass every rule;
elsewhere the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.columns import col, others, packed, unpacked
from gyre.llm.names import mix
from gyre.llm.words import forget, word_hashes
from gyre.session import materialize, ship, sized

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
VERDICTS = ("base_failed", "rule_failed", "host_rate", "host_strict", "kept")

#: Words of a window for n_repeat_words.
WINDOW = 5
#: Weight of the prior, in documents, at least and at most.
LEAST_PRIOR, MOST_PRIOR = 1.0, 1000.0


def repeated_words(text: bytes) -> tuple[int, int]:
    """Number of words, and of those in a window of 5 words that the text has twice or more."""
    h = word_hashes(text)
    n = len(h) - WINDOW + 1
    if n < 2:
        return len(h), 0
    x = mix(h[:n])
    for k in range(1, WINDOW):
        x = mix(x ^ (h[k : n + k] * np.uint64(2 * k + 1)))
    order = np.argsort(x)
    s = x[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return len(h), 0
    twice = np.zeros(n, bool)
    twice[order[np.r_[same, False] | np.r_[False, same]]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return len(h), int((np.cumsum(edge[:-1]) > 0).sum())


def _counts(column: pa.Array) -> list[pa.Array]:
    chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(COUNTS), len(column)), np.int64)
    for i, text in enumerate(column.cast(pa.large_binary()).to_pylist()):
        if text:
            n, repeated = repeated_words(text)
            lines = [x for x in text.split(b"\n") if x.strip()]
            spaces = len(text) - len(text.translate(None, _SPACE))
            out[:, i] = n, chars[i] - spaces, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)
    return [pa.array(row) for row in out]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts in COUNTS (long), all 0 for a null text; columns of docs with these names (without case) are replaced.

    Words are runs of bytes other than ASCII white space; n_lines counts lines
    (between line feeds) with a word, n_dup_lines those equal to an earlier one.
    """
    rows, own = _with_text(docs, COUNTS, text_col)
    return counted(rows, text_col).select(*unpacked(own), *COUNTS)


def _with_text(docs: DataFrame, outputs: Sequence[str], text_col: str, **inputs: Column) -> tuple[DataFrame, list[T.StructField]]:
    """docs packed, with the text beside only where the packed row doesn't hold it."""
    held = any(f.name == text_col for f in others(docs, outputs))
    return packed(docs, outputs, **inputs, **({} if held else {"text": col(text_col)}))


def counted(rows: DataFrame, text_col: str) -> DataFrame:
    """Packed rows with the counts of their text."""
    ship(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    beside = "text" in rows.columns
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in COUNTS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text") if beside else pc.struct_field(batch.column("row"), text_col)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_counts(text)], names=[*names, *COUNTS])
        forget()

    return rows.mapInArrow(count, schema)


def _rules() -> tuple:
    words = F.col("n_words")
    base = (words < 10) | (100 * F.col("n_repeat_words") > 20 * words)
    more = (10 * F.col("n_symbols") > words) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | (F.col("word_chars") < 3 * words) | (F.col("word_chars") > 10 * words)
    return base, base | more


def host_rates(counted: DataFrame, host_col: str) -> DataFrame:
    """Per host the number of documents, of failures, and the shrunk rate of failures.

    The prior weighs LEAST_PRIOR documents at least and MOST_PRIOR at most.
    Rates enter the moments in whole millionths and are summed exactly, so that
    the result doesn't depend on the order of rows.
    """
    hosts = counted.where(F.col(f"`{host_col}`").isNotNull()).groupBy(F.col(f"`{host_col}`").alias("host")).agg(F.count("*").alias("n"), F.sum(_rules()[1].cast("long")).alias("failures"))
    hosts = materialize(hosts, "hosts")
    p = F.expr("failures * 1000000 div n").cast("decimal(20,0)")
    moments = hosts.agg(F.count("*").alias("h"), F.sum(p).cast("double").alias("s1"), F.sum(p * p).cast("double").alias("s2"))
    mean = F.col("s1") / F.col("h")
    prior = moments.select((mean / F.lit(1e6)).alias("m"), ((F.col("s2") / F.col("h") - mean * mean) / F.lit(1e12)).alias("v"))
    weight = F.when(F.col("v") > 0, F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(LEAST_PRIOR), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).otherwise(F.lit(MOST_PRIOR))
    prior = prior.select("m", weight.alias("k")).first()
    m, k = prior["m"] or 0.0, prior["k"]
    return hosts.withColumn("rate", (F.col("failures") + F.lit(m * k)) / (F.col("n") + F.lit(k)))


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5, carried: Sequence[str] | None = None) -> DataFrame:
    """docs with the counts, base_failed, rule_failed, host_rate (null without a host), host_strict and kept.

    kept is false for a document that fails a base rule (under 10 words, or over
    20 % of them in repeated windows), and for one of a strict host (shrunk rate
    of failures of host_limit or more) that fails any rule. A null host is
    judged by the document alone. A null text fails; equal rows have equal
    results; an empty table gives no rows; columns with the outputs' names
    (without case) are replaced. carried names the columns of docs that the
    result keeps, all unless it is given. What is named is written with the
    counts, so that texts are measured once.
    """
    left_out = [] if carried is None else [f.name for f in others(docs, carried)]
    rows, own = _with_text(docs, (*COUNTS, *VERDICTS, *left_out), text_col, host=col(host_col))
    rows = counted(rows, text_col)
    if carried is None:
        # measured for the rates and again for the verdicts, as a table of all texts would cost more than that
        of_hosts = counted(docs.select(col(host_col).alias("host"), col(text_col).alias("text")), text_col)
    else:
        of_hosts = rows = materialize(rows, "counts")
    base, any_rule = _rules()
    strict = materialize(host_rates(of_hosts, "host").select("host", F.col("rate").alias("host_rate")), "rates")
    out = rows.withColumns({"base_failed": base, "rule_failed": any_rule}).join(sized(strict), "host", "left")
    out = out.withColumn("host_strict", F.coalesce(F.col("host_rate") >= host_limit, F.lit(False)))
    kept = ~F.col("base_failed") & ~(F.col("host_strict") & F.col("rule_failed"))
    return out.select(*unpacked(own), *COUNTS, "base_failed", "rule_failed", "host_rate", "host_strict", kept.alias("kept"))
