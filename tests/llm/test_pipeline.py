"""The pipeline: all stages against plain versions of them, and each stage on edge cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gyre.llm.packing import best_fit, least_bins
from gyre.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(name, words=120):
    return " ".join(f"{name}{i}" for i in range(words))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


A, B, C, D, E, G = (text_of(x) for x in "abcdeg")


@pytest.mark.parametrize(
    ("rows", "stay"),
    [
        ([(1, A), (2, B), (1, A), (1, A)], [(1, A), (2, B)]),  # a repeated row
        ([(3, C), (None, C)], [(3, C)]),  # a copy without an id
        ([(None, D), (None, D)], [(None, D)]),  # copies, none with an id
        ([(9, E), (4, E + " more"), (None, E)], [(4, E + " more")]),  # near copies: the smallest id
        ([(5, A), (3, A), (5, G)], [(3, A), (5, G)]),  # an id with another text besides
    ],
)
def test_one_of_each_group_stays(spark, rows, stay):
    once = P.near_dedup(spark, frame(spark, rows), "")
    assert rows_of(once) == stay
    assert rows_of(P.passage_dedup(spark, once, "")) == stay


# --- plain versions


def plain_quality(docs):
    counted = []
    for d in docs:
        w = WORD.findall(d["text"] or "")
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often, again = Counter(windows), set()
        for i, x in enumerate(windows):
            if often[x] > 1:
                again.update(range(i, i + 5))
        lines = [x for x in (d["text"] or "").split("\n") if WORD.search(x)]
        chars = sum(map(len, w))
        base = len(w) < 10 or 100 * len(again) > 20 * len(w)
        rule = base or 10 * sum(c in "#*$%&|<>" for c in d["text"]) > len(w) or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or not 3 * len(w) <= chars <= 10 * len(w)
        counted.append((d, base, rule))
    hosts = {}
    for d, _, rule in counted:
        if d["source"] is not None:
            n, f = hosts.get(d["source"], (0, 0))
            hosts[d["source"]] = (n + 1, f + rule)
    p = [f * 1_000_000 // n for n, f in hosts.values()]
    mean = sum(p) / len(p)
    m, v = mean / 1e6, (sum(x * x for x in p) / len(p) - mean * mean) / 1e12
    k = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
    strict = {h: (f + m * k) / (n + k) >= 0.5 for h, (n, f) in hosts.items()}
    return [d for d, base, rule in counted if not base and not (strict.get(d["source"], False) and rule)]


def shingles(text, size=5):
    w = WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def plain_near(docs):
    sets, group = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for i in sorted(range(len(docs)), key=lambda i: docs[i]["doc_id"]):
        first.setdefault(group[i], i)
    return [docs[i] for i in sorted(first.values())]


def plain_passages(docs, words=P.PASSAGE_WORDS):
    spans = [[m.span() for m in WORD.finditer(d["text"])] for d in docs]
    where = Counter()
    runs = lambda k: [tuple(docs[k]["text"][a:b] for a, b in spans[k][i : i + words]) for i in range(len(spans[k]) - words + 1)]
    for k in range(len(docs)):
        where.update(runs(k))
    out = []
    for k, d in enumerate(docs):
        gone, text = set(), ""
        for i, run in enumerate(runs(k)):
            if where[run] > 1:
                gone.update(range(spans[k][i][0], spans[k][i + words - 1][1]))
        text = "".join(c for i, c in enumerate(d["text"]) if i not in gone)
        if WORD.search(text):
            out.append(d | {"text": text, "n_chars": len(text)})
    return out


def plain_decontaminate(docs, items):
    out = []
    for d in docs:
        w, held = WORD.findall(d["text"].lower()), False
        for item in items:
            own = WORD.findall(item.lower())
            k = min(5, len(own))
            mine = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            theirs = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
            starts = {max(0, min(p - o, len(w) - len(own))) for o, x in enumerate(theirs) for p, y in enumerate(mine) if x == y}
            for s in starts:
                a, b = Counter(mine[s : s + len(theirs)]), Counter(theirs)
                held |= 100 * (a & b).total() >= 80 * (a | b).total()
        if not held:
            out.append(d)
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents for every stage's decisions, and benchmark items, as a folder of tables."""
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(("stone", "river", "märz", "cloud", "über", "seven")) + str(r.randint(0, 400)) for _ in range(n))
    items, passages = [prose(n) for n in (16, 30, 45, 59)], [prose(n) for n in (51, 60, 90)]
    docs = [prose(r.randint(30, 120)) for _ in range(30)]
    docs += [prose(40) + "\n" + p + "\n\n" + prose(20) for p in passages for _ in range(3)]
    docs += [prose(30) + " " + i + " " + prose(30) for i in items] + [items[2].upper() + " " + prose(12)]
    docs += [docs[0], docs[1] + " one more", docs[2], prose(60) + " Ünicode"]  # copies
    docs += ["too few words", "a b c d e " * 12, "# $ % & " * 10 + prose(20), "", None, " \n"]
    # a strict host: most of its documents fail
    rows = [(100 + i * 3, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(docs)]
    rows += [(900 + i, "same words again " * 10, "en", "bad", 170) for i in range(6)] + [(950, "x y " * 3 + " ".join("zq"[j % 2] + str(j) for j in range(40)), "en", "bad", 200), (951, prose(50), "en", None, 300)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = ("doc_id", "text", "lang", "source", "n_chars")
    return str(folder), [dict(zip(names, x, strict=True)) for x in rows], items


def test_all_stages_against_plain_versions(spark, corpus):
    from tokenizers import Tokenizer

    folder, docs, items = corpus
    plain = [d | {"text": d["text"] or ""} for d in docs]
    steps = [plain_quality, plain_near, plain_passages, lambda x: plain_decontaminate(x, items)]
    got = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [len(docs)]
    for (name, stage), step in zip(P.STAGES[:-1], steps, strict=True):
        got, plain = stage(spark, got, folder).persist(), step(plain)
        assert sorted(tuple(r) for r in got.select("doc_id", "text", "n_chars").collect()) == sorted((d["doc_id"], d["text"], d["n_chars"]) for d in plain), name
        assert got.columns == list(P.COLUMNS)
        sizes.append(len(plain))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 20
    tokenizer, wanted, counts = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Counter(), Counter()
    for d in plain:
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)])):
            wanted[d["doc_id"], k, tuple(ids[a:b])] += 1
            counts[b - a] += 1
    rows = P.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, tuple(memoryview(bytes(r.ids)).cast("I"))) for r in rows) == wanted
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert least_bins(counts, 1024) <= len(held) <= sum(best_fit({}, counts, 1024).values())


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_stages_on_edge_cases(spark, corpus, name, stage):
    """Nulls in any column, empty and very long texts, ties, repeated rows, more columns, an empty table."""
    folder, _, items = corpus
    long = " ".join(f"w{i}x{i % 991}" for i in range(20_000))
    rows = [(1, A, "en", "a", 5), (1, A, "en", "a", 5), (2, None, None, None, None), (None, B, None, "a", None), (3, "", "en", "a", 0), (4, long, "en", None, 9), (5, " \n ", "de", "b", 3), (None, None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", Kept string, _host string, N_Words int")
    out = stage(spark, df, folder)
    found = out.collect()
    if name == "best-fit packing":
        assert Counter(r.doc_id for r in found if r.piece == 0) == Counter(r[0] for r in rows)
        assert stage(spark, df.where("false"), folder).count() == 0
        return
    assert out.columns == list(P.COLUMNS) and stage(spark, df.where("false"), folder).count() == 0
    texts = Counter((r.doc_id, r.text) for r in found)
    blank = {(2, None), (3, ""), (5, " \n "), (None, None)}
    assert texts[4, long] == 1 and texts[None, B] == 1
    if name == "quality rules":
        assert texts == Counter({(1, A): 2, (None, B): 1, (4, long): 1})
    elif name == "MinHash near-dedup":
        assert texts == Counter({(1, A): 1, (None, B): 1, (4, long): 1, **{x: 1 for x in blank}})
    elif name == "suffix-array dedup":
        assert texts == Counter({(None, B): 1, (4, long): 1})  # repeated rows hold each other's runs
    else:
        assert texts == Counter({(1, A): 2, (None, B): 1, (4, long): 1, **{x: 1 for x in blank}})


def test_passages_of_51_words(spark):
    """A passage of over 50 words goes from both documents, whatever its bytes; one of 49 stays."""
    short, shorter = " ".join(f"s{i}" for i in range(51)), " ".join(f"t{i}" for i in range(49))
    rows = [(1, f"{A} {short} ünd"), (2, f"ß {short}\n{B}"), (3, f"{C} {shorter}"), (4, f"{shorter} {D}")]
    got = dict(rows_of(P.passage_dedup(spark, frame(spark, rows), "")))
    assert got == {1: f"{A}  ünd", 2: f"ß \n{B}", 3: f"{C} {shorter}", 4: f"{shorter} {D}"}


def test_no_stage_reads_the_order_of_rows(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:2]:
        assert rows_of(stage(spark, docs.orderBy(F.rand(1)), folder).where("text IS NOT NULL")) == rows_of(stage(spark, docs.orderBy(F.rand(2)), folder).where("text IS NOT NULL"))
