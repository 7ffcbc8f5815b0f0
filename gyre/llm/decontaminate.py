"""Documents that hold a benchmark item: SimHash of windows, Hamming blocks, exact similarity.

DataFrame functions only. Every document is cut into windows on a grid of
STRIDE words, in the sizes that items have (their size classes), and each
window gets a fingerprint. Items are indexed by the fingerprints of their own
windows of the class at all offsets: wherever an item stands in a document,
the grid meets one of its offsets. Fingerprints are cut into one block more
than the radius, so that a pair within the radius agrees in a block; blocks are
long enough to select. Of the pairs found, weighted shingles of item-sized
windows decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyre.llm.columns import col, packed, unpacked
from gyre.session import materialize, sized

#: Words between the windows of a document, and window sizes in shingles.
STRIDE, CLASSES = 4, (4, 8, 16)
#: Bits in which fingerprints may differ; blocks are one more.
RADIUS = 2
_SHIFTS, _WIDTHS = (0, 22, 43), (22, 21, 21)
#: Rows of the index that are broadcast (32 bytes each); a larger one is joined by a shuffle.
MOST_INDEX = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: Column | int) -> Column:
    """64-bit hashes of the word n-grams, from the hashes of the words; none if there are fewer words than width."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(hashes) - width + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, width)))


def fingerprints(rows: DataFrame, classes: tuple[int, ...], width: int = 5) -> DataFrame:
    """rows with f4, f8, f16 (those in classes): 64-bit SimHash of the first 4, 8, 16 shingles of `hashes`, null if there are fewer.

    A bit is set if more than half of the shingles have it, counted with their
    repetitions. The counts of all 64 bits are added up at once, a digit a column.
    """
    own, most = rows.columns, max(classes)
    n = F.size("hashes")
    # 0 stands for words behind the end: windows that reach there are left out below
    rows = rows.select(*own, n.alias("n_hashes"), *[F.coalesce(F.get("hashes", F.lit(i)), F.lit(0).cast("long")).alias(f"w{i}") for i in range(most + width - 1)])
    rows = rows.select(*own, "n_hashes", *[F.xxhash64(*[f"w{i + k}" for k in range(width)]).alias(f"s{i}") for i in range(most)])
    numbers, size = [[f"s{i}"] for i in range(most)], 1
    made = []
    while size < most:
        size *= 2
        pairs = [(numbers[k], numbers[k + 1]) for k in range(0, len(numbers), 2)]
        names = [[f"a{size}x{k}x{digit}" for digit in range(len(pairs[0][0]) + 1)] for k in range(len(pairs))]
        carries: list[Column | None] = [None] * len(pairs)
        # a digit of all sums of this size at once: a sum's digit, and what it carries into the next
        for digit in range(len(pairs[0][0])):
            columns = {}
            for k, (left, right) in enumerate(pairs):
                x, y, carry = F.col(left[digit]), F.col(right[digit]), carries[k]
                either = x.bitwiseXOR(y)
                columns[names[k][digit]] = either if carry is None else either.bitwiseXOR(carry)
                columns[f"{names[k][digit]}c"] = x.bitwiseAND(y) if carry is None else x.bitwiseAND(y).bitwiseOR(carry.bitwiseAND(either))
                carries[k] = F.col(f"{names[k][digit]}c")
            rows = rows.withColumns(columns)
        for k, name in enumerate(names):
            name[-1] = f"{names[k][-2]}c"
        numbers = names
        if size in classes:
            # over half of 2^k: the highest digit, or the next and any lower one
            *low, half, top = (F.col(c) for c in numbers[0])
            some = low[0]
            for c in low[1:]:
                some = some.bitwiseOR(c)
            rows = rows.withColumn(f"f{size}", F.when(F.col("n_hashes") >= size + width - 1, top.bitwiseOR(half.bitwiseAND(some))))
            made.append(f"f{size}")
    return rows.select(*own, *made)


def keys(fingerprint: Column, size: int) -> list[Column]:
    """The blocks of a fingerprint of a size class, each with its number and the class in one long."""
    out = []
    for k, (shift, width) in enumerate(zip(_SHIFTS, _WIDTHS, strict=True)):
        block = F.call_function("shiftrightunsigned", fingerprint, F.lit(shift)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        out.append(block.bitwiseOR(F.lit((size << 3 | k) << 32).cast("long")))
    return out


def size_class(m: Column, percent: int, width: int) -> Column:
    """The size of the windows that an item of m shingles is looked up by, 1 for the shortest items.

    A window that reaches the similarity has need of the item's m shingles. An
    edit within it costs width - 1 at least, so that the others lie in so many
    runs; the longest holds a window on the grid if it is a class and the
    stride less one long.
    """
    need = F.ceil(F.lit(2 * percent) * m / F.lit(100 + percent))
    run = F.ceil(need / (F.floor((m - need) / F.lit(width - 1)) + 1))
    out = F.lit(1)
    for size in CLASSES:
        out = F.when(run >= size + STRIDE - 1, F.lit(size)).otherwise(out)
    return out


def numbered(hashes: Column) -> Column:
    """The bag as a set: each hash with the number of its earlier occurrences, so that intersections count weights."""
    ordered = F.sort_array(hashes)
    return F.transform(ordered, lambda h, i: F.struct(h.alias("h"), (i + 1 - F.array_position(ordered, h)).alias("k")))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(text_md5, item_id, similarity, window_start) for each text of docs and each item it holds, the best window's.

    A text holds an item if 100 * sum of minima >= percent * sum of maxima of
    the shingle counts of the item and of a window of as many words in which a
    shingle has the same place as in the item (moved inwards at the text's ends;
    the whole text if it is shorter). Shingles are width lower-cased words, the
    whole item if it has fewer. Null, empty and blank texts and items hold
    nothing; equal items and texts are found alike; items without an id count
    under null; empty tables give no rows.

    Looked up by fingerprints (see candidates), which find every pair of which a
    run of shingles long enough is unchanged. The items' side is broadcast only
    up to a checked number of rows.
    """
    items, keyed = _items(benchmark, item_col, item_text_col, width), _keyed(docs, text_col)
    found = materialize(candidates(keyed, items, width, percent), "candidates")
    # the documents found, once each
    texts = keyed.join(sized(materialize(found.select("text_md5").distinct(), "hits")), "text_md5", "left_semi").dropDuplicates(["text_md5"])
    texts = texts.select("text_md5", word_hashes(words_of(F.col("text"))).alias("hashes"))
    pairs = found.join(items.select("item", "item_id", "n", "w", "bag"), "item").join(texts, "text_md5")
    pairs = pairs.select("text_md5", "item_id", "item", "n", "w", "bag", F.size("hashes").alias("n_words"), shingle_hashes(F.col("hashes"), F.col("w")).alias("shingles"))
    pairs = materialize(pairs, "pairs")
    # a shingle of the text at place p and of the item at place o puts the window at p - o
    places = pairs.select("text_md5", "item", "n", "n_words", F.posexplode("shingles").alias("p", "h"))
    offsets = items.select("item", F.posexplode("bag").alias("o", "h"))
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("n_words") - F.col("n")))
    starts = places.join(sized(materialize(offsets, "offsets")), ["item", "h"]).select("text_md5", "item", start.alias("start")).groupBy("text_md5", "item").agg(F.collect_set("start").alias("starts"))
    windows = pairs.join(starts, ["text_md5", "item"]).select("text_md5", "item_id", "n", "w", "bag", "shingles", F.explode("starts").alias("start"))
    held = F.slice("shingles", F.col("start") + 1, F.greatest(F.lit(1), F.col("n") - F.col("w") + 1))
    windows = windows.select("text_md5", "item_id", "start", "bag", held.alias("held"))
    both = F.size(F.array_intersect(numbered(F.col("held")), numbered(F.col("bag"))))
    exact = windows.select("text_md5", "item_id", "start", both.alias("both"), (F.size("held") + F.size("bag")).alias("sizes"))
    exact = exact.withColumn("all", F.col("sizes") - F.col("both")).where(F.lit(100) * F.col("both") >= F.lit(percent) * F.col("all"))
    best = exact.groupBy("text_md5", "item_id").agg(F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("start")).alias("s"))).alias("best"))
    return best.select("text_md5", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("window_start"))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, width: int) -> DataFrame:
    """(item, item_id, n words, w, hashes of its words, bag of its shingles, m of them), each different item once."""
    own = benchmark.select(col(item_col).alias("item_id"), words_of(col(item_text_col)).alias("words")).where(F.size("words") > 0).distinct()
    own = own.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n"), F.least(F.lit(width), F.size("words")).alias("w"), word_hashes(F.col("words")).alias("hashes"))
    return materialize(own.withColumn("bag", shingle_hashes(F.col("hashes"), F.col("w"))).withColumn("m", F.size("bag")), "items")


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = col(text_col)
    return docs.select(F.unhex(F.md5(text)).alias("text_md5"), text.alias("text")).where("text is not null")


def candidates(keyed: DataFrame, items: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct (text_md5, item) of which a window's fingerprint is within RADIUS of one of the item's.

    Items of class 1 are looked up by every shingle: the fingerprint of one
    shingle is its hash, of which 64 bits must agree.
    """
    size = F.when(F.col("w") == width, size_class(F.col("m"), percent, width)).otherwise(F.lit(1))
    classed = items.select("item", "w", "hashes", "bag", size.alias("size"))
    present = classed.select("size", "w").distinct().collect()  # width + len(CLASSES) rows at most
    classes = tuple(sorted({r.size for r in present} - {1}))
    texts = keyed.select("text_md5", word_hashes(words_of(F.col("text"))).alias("words"))
    found = []
    if classes:
        # an item's windows of its class at every offset
        offsets = F.transform(F.sequence(F.lit(1), F.size("bag") - F.col("size") + 1), lambda o: F.slice(F.col("hashes"), o, F.col("size") + width - 1))
        own = fingerprints(classed.where("size > 1").select("item", "size", F.explode(offsets).alias("hashes")), classes, width)
        index = F.explode(F.array(*[F.struct(F.lit(c).alias("size"), F.col(f"f{c}").alias("f"), F.array(*keys(F.col(f"f{c}"), c)).alias("keys")) for c in classes]))
        index = own.select("item", "size", index.alias("i")).where("i.size = size").select("item", F.col("i.f").alias("item_f"), F.explode("i.keys").alias("key"))
        index = materialize(index.distinct(), "index")
        # windows that reach behind the end have no fingerprint. explode_outer, as explode makes the optimizer compute the array for a filter too
        grid = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(min(classes) + width - 2)), F.lit(STRIDE))
        cut = F.transform(grid, lambda i: F.slice(F.col("words"), i, max(classes) + width - 1))
        rows = texts.select("text_md5", F.explode_outer(cut).alias("hashes"))
        rows = fingerprints(rows, classes, width).select("text_md5", *[f"f{c}" for c in classes])
        asked = rows.select("text_md5", *[f"f{c}" for c in classes], F.explode_outer(F.array(*[k for c in classes for k in keys(F.col(f"f{c}"), c)])).alias("key"))
        met = asked.where("key is not null").join(sized(index, MOST_INDEX), "key")
        f = F.coalesce(*[F.when(F.call_function("shiftright", F.col("key"), F.lit(35)) == c, F.col(f"f{c}")) for c in classes])
        found.append(met.where(F.bit_count(f.bitwiseXOR(F.col("item_f"))) <= RADIUS).select("text_md5", "item"))
    short = sorted({r.w for r in present if r.size == 1})
    if short:
        index = materialize(classed.where("size = 1").select("item", F.explode("bag").alias("key")).distinct(), "index")
        rows = texts.select("text_md5", F.explode_outer(F.concat(*[shingle_hashes(F.col("words"), w) for w in short])).alias("key"))
        found.append(rows.join(sized(index, MOST_INDEX), "key").select("text_md5", "item"))
    if not found:
        return keyed.where("false").select("text_md5", F.lit(0).cast("long").alias("item"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def flag(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with contaminated, n_items and similarity (the largest, null if none); columns with these names (without case) are replaced.

    Null and blank texts are not contaminated; repeated rows and equal texts
    have equal results; an empty table gives no rows.
    """
    found = contaminated(docs, benchmark, text_col, **options)
    by_text = materialize(found.groupBy("text_md5").agg(F.count("*").alias("n_items"), F.max("similarity").alias("similarity")), "flagged")
    rows, own = packed(docs, ("contaminated", "n_items", "similarity"), text_md5=F.unhex(F.md5(col(text_col))))
    out = rows.join(sized(by_text), "text_md5", "left")
    return out.select(*unpacked(own), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "similarity")
