"""The longest of many stored sequences that begins another one, at any length."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.session import materialize, ship, sized


def _digests(tokens: list[str], lengths: set[int]) -> list[tuple[int, bytes]]:
    """The 128-bit digests of the prefixes of these lengths, in one pass."""
    state, out = xxhash.xxh3_128(), []
    for n, token in enumerate(tokens, 1):
        data = token.encode()
        state.update(len(data).to_bytes(4, "little") + data)
        if n in lengths:
            out.append((n, state.digest()))
    return out


def _marked(rows: DataFrame, name: str, tokens: str, lengths: set[int] | None, whole: bool) -> DataFrame:
    """(name, size, digest) of the prefixes of rows that have one of the lengths; lengths None: powers of two. whole: the sequence itself as well."""
    kind = rows.schema[name].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, found = [], [], []
            for i, words in enumerate(batch.column(1).to_pylist()):
                own = {1 << k for k in range(len(words or []).bit_length())} if lengths is None else lengths
                for n, digest in _digests(words or [], own | {len(words or [])} if whole else own):
                    names.append(i)
                    sizes.append(n)
                    found.append(digest)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(names, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.binary())], names=[name, "size", "digest"])

    return rows.select(name, tokens).mapInArrow(mark, f"{name} {kind}, size int, digest binary")


def longest_prefixes(asked: DataFrame, stored: DataFrame, name: str, tokens: str) -> DataFrame:
    """(name, size, entry): for rows of asked whose tokens begin with some row of stored, the size of the longest such row and the smallest name of those.

    Two equi-joins on digests of prefixes, whatever the lengths. Stored rows
    leave marks at the powers of two up to their size; the marks that a row of
    asked meets bound the entries that may begin it to less than twice the
    largest, so that rows that share nothing, nearly all as a rule, end here.
    Then the sizes that entries have below that bound are looked up. Equality
    is that of 128-bit digests. Null and empty sequences neither ask nor
    answer; ties go to the smallest name.
    """
    ship(asked.sparkSession)
    entries = materialize(_marked(stored, name, tokens, set(), True).groupBy("size", "digest").agg(F.min(name).alias("entry")), "entries")
    lengths = [r[0] for r in entries.select("size").distinct().limit(100_000).collect()]  # numbers of tokens
    if len(lengths) == 100_000:
        raise ValueError("entries of over 100,000 different sizes")
    # no entry is longer: what follows in a row of asked decides nothing
    asked = asked.select(name, F.slice(tokens, 1, max(lengths, default=0)).alias(tokens))
    marks = materialize(_marked(stored, name, tokens, None, False).select("size", "digest").distinct(), "marks")
    met = _marked(asked, name, tokens, None, False).join(sized(marks), ["size", "digest"], "left_semi").groupBy(name).agg((2 * F.max("size")).alias("below"))
    left = materialize(asked.select(name, tokens).join(met, name), "left")
    found = _marked(left, name, tokens, set(lengths), False).join(entries, ["size", "digest"])
    return found.groupBy(name).agg(F.max(F.struct("size", "entry")).alias("x")).select(name, "x.size", "x.entry")
