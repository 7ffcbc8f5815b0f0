"""Packing: the genetic algorithm against the optimum of small cases, and the query against plain encoding."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from gyre.llm.packing import best_fit, evolve, filled, least_bins, pieces, solve, used
from gyre.llm.queries import op9_packing
from gyre.llm.tokens import vocabulary


def fewest(lengths, capacity):
    """The optimum by trying every choice for the largest piece's bin."""

    @lru_cache(None)
    def need(left):
        if not left:
            return 0
        first, rest, best = left[0], left[1:], len(left)
        for mask in range(1 << len(rest)):
            if first + sum(x for i, x in enumerate(rest) if mask >> i & 1) <= capacity:
                best = min(best, 1 + need(tuple(x for i, x in enumerate(rest) if not mask >> i & 1)))
        return best

    return need(tuple(sorted(lengths, reverse=True)))


def valid(bins, counts, capacity):
    return used(bins) == +counts and all(sum(c) <= capacity and n > 0 for c, n in bins.items())


@pytest.mark.parametrize("seed", range(12))
def test_small_cases_reach_the_optimum(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 20) for _ in range(r.randint(0, 10))]
    counts, best = Counter(lengths), fewest(lengths, 20)
    assert least_bins(counts, 20) <= best
    for bins in (best_fit({}, counts, 20), filled(counts, 20), filled(counts, 20, 3), evolve(counts, 20, [], seed)[0]):
        assert valid(bins, counts, 20) and sum(bins.values()) >= best
    assert sum(evolve(counts, 20, [], seed)[0].values()) == best


def test_the_search_gains_on_best_fit(spark):
    """A case that best-fit decreasing packs badly: bins of 1024 cut in three at random."""
    r = random.Random(5)
    counts = Counter()
    for _ in range(150):
        a, b = sorted(r.sample(range(60, 1000), 2))
        counts.update([a, b - a, 1024 - b])
    fitted, found = best_fit({}, counts, 1024), solve(spark, counts, 1024, islands=2, epochs=1)
    assert valid(found, counts, 1024) and sum(found.values()) < sum(fitted.values())
    assert sum(found.values()) <= 152


def test_bounds_of_large_pieces():
    assert least_bins(Counter({513: 7}), 1024) == 7
    assert least_bins(Counter({1024: 3, 1: 1024}), 1024) == 4
    assert least_bins(Counter({700: 4, 400: 2, 300: 4}), 1024) == 5
    assert least_bins(Counter(), 1024) == 0 and filled(Counter(), 1024) == {}


def test_query_against_plain_encoding(spark):
    """All documents: ids of the tokenizers library, cut by hand; places without gaps; no more sequences than best fit makes."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    wanted, counts = Counter(), Counter()
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            wanted[row.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
            counts[b - a] += 1
    rows = op9_packing(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert least_bins(counts, 1024) <= len(held) <= sum(best_fit({}, counts, 1024).values())


def test_hot_lengths_and_repeated_rows(spark):
    """Many equal documents, dealt over tasks: each piece has a place of its own."""
    docs = spark.range(4000).selectExpr("id % 3 AS doc_id", "'same text' AS text").repartition(7)
    from gyre.llm.packing import pack

    rows = pack(docs, vocabulary("byte_bpe_50k.json"), 64, islands=1, epochs=1).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4000 and {r.length for r in rows} == {3}
    assert len({r.sequence_id for r in rows}) == -(-4000 // 21)
    assert pieces(docs.where("false"), vocabulary("byte_bpe_50k.json"), 64).count() == 0
