"""Language identification by unigrams of pieces, marginalised over segmentations.

A language gives each piece of a fixed public vocabulary a probability. The
probability of a word is the sum, over all ways to cut it into pieces, of the
product of theirs; a forward pass over the word's bytes adds these up. Training
is expectation-maximisation with the same sums, from labelled words.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gyre.llm.columns import col, packed, unpacked
from gyre.session import ship

#: Labelled texts in training at most, in all and of a language: the documented bound of the sample.
SAMPLE_ROWS, SAMPLE_ROWS_LANG = 4000, 700
#: Bytes of a stretch that training takes a longer word apart into, bytes that a stretch shares with the one before (the longest piece has 33), and languages of a model.
STRETCH, SHARED, MOST_LANGUAGES = 200, 36, 500
#: Words in a worker's cache at most, and bytes of a word that enters it.
MOST, CACHED_WORD = 500_000, 200
#: The score is the probability among the languages for so many bytes of the text on average.
SCORED = 48

_FACTOR = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)
#: Positions after which forward sums are scaled: no product of as many pieces falls below what a double holds.
_EVERY = 16


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file in the tiktoken layout, all single bytes included."""
    with open(path, "rb") as f:
        found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in found if p} | {bytes([b]) for b in range(256)})


def _step(x: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Hashes of one byte more."""
    x = (x ^ data) * _FACTOR
    x ^= x >> np.uint64(29)
    return x


class Vocabulary:
    """Pieces by the hash of their bytes, and the hashes of their beginnings."""

    def __init__(self, pieces: list[bytes]):
        whole, begun = [], []
        self.longest = max(map(len, pieces))
        for n in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == n]
            if own:
                data = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n).astype(np.uint64)
                x = np.full(len(own), _SEED)
                for k in range(n):
                    x = _step(x, data[:, k])
                    begun.append(x)
                whole.append(x)
        self.codes = np.sort(np.concatenate(whole))
        self.begun = np.unique(np.concatenate(begun))

    def __len__(self) -> int:
        return len(self.codes)

    def _found(self, table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, x)
        at[at == len(table)] = 0
        return at, table[at] == x

    def pieces_at(self, data: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For places (row, start) in a matrix of bytes: (length, which places, which pieces) for every piece that stands there."""
        live, x, width = np.arange(len(starts)), np.full(len(starts), _SEED), data.shape[1]
        for n in range(1, self.longest + 1):
            inside = starts[live] + n <= width
            live, x = live[inside], x[inside]
            if not len(live):
                return
            x = _step(x, data[rows[live], starts[live] + (n - 1)])
            at, hit = self._found(self.codes, x)
            if hit.any():
                yield n, live[hit], at[hit]
            on = self._found(self.begun, x)[1]
            live, x = live[on], x[on]

    def lattice(self, words: list[bytes]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of one length, by start, the pieces in them: (end, which words, which pieces)."""
        data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.uint64)
        every = np.arange(len(words))
        return [[(start + n, hit, piece) for n, hit, piece in self.pieces_at(data, every, np.full(len(words), start))] for start in range(data.shape[1])]


def sums(lattice: list[list[tuple[int, np.ndarray, np.ndarray]]], probabilities: np.ndarray, words: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (positions x words x languages) over all segmentations, and the logarithms that scale them, by position."""
    n = len(lattice)
    ahead = np.zeros((n + 1, words, probabilities.shape[1]))
    logs = np.zeros_like(ahead)
    ahead[0] = 1.0
    log = logs[0]
    for start, pieces in enumerate(lattice):
        if start and start % _EVERY == 0:
            open_ = ahead[start : start + longest]
            most = open_.max(axis=0)
            open_ /= most
            log = log + np.log(most)
        logs[start] = log
        for end, hit, piece in pieces:
            ahead[end, hit] += ahead[start, hit] * probabilities[piece]
    logs[n] = log
    return ahead, logs


def forward(vocabulary: Vocabulary, probabilities: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probabilities (words x languages) of words of one length, of all their segmentations together."""
    ahead, logs = sums(vocabulary.lattice(words), probabilities, len(words), vocabulary.longest)
    return np.log(ahead[-1]) + logs[-1]


def forward_long(vocabulary: Vocabulary, probabilities: np.ndarray, word: bytes) -> np.ndarray:
    """The same for a long word by itself, a position at a time; memory is bounded, whatever its length."""
    data, longest, block = np.frombuffer(word, np.uint8).astype(np.uint64)[None, :], vocabulary.longest, 1 << 14
    open_ = np.zeros((longest + 1, probabilities.shape[1]))  # the sum of position p is in row p modulo their number
    size = len(open_)
    open_[0] = 1.0
    log = np.zeros(probabilities.shape[1])
    for lo in range(0, len(word), block):
        starts = np.arange(lo, min(len(word), lo + block))
        found = [(np.full(len(at), n), starts[at], piece) for n, at, piece in vocabulary.pieces_at(data, np.zeros(len(starts), np.int64), starts)]
        n, start, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        rows, weights = (start + n)[order] % size, probabilities[piece[order]]
        ends = np.searchsorted(start[order], starts, "right")
        a = 0
        for p, b in zip(starts.tolist(), ends.tolist(), strict=True):
            own = open_[p % size]
            if p % _EVERY == 0:
                most = open_.max(axis=0)
                open_ /= most
                log += np.log(most)
            open_[rows[a:b]] += own * weights[a:b]  # the ends of pieces from one start differ
            own[:] = 0.0
            a = b
    return np.log(open_[len(word) % size]) + log


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, each behind a space."""
    return [b" " + w for w in text.split()]


def stretches(word: bytes) -> Iterator[bytes]:
    """A word in overlapping stretches of at most STRETCH bytes and of whole characters; each piece of the word lies whole in one at least."""
    start = 0
    while len(word) - start > STRETCH:
        end = start + STRETCH
        while word[end] & 0xC0 == 0x80:
            end -= 1
        yield word[start:end]
        start = end - SHARED
        while word[start] & 0xC0 == 0x80:
            start -= 1
    yield word[start:]


def by_length(words: list[bytes], most: int = 400_000) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Words of one length together, of about most bytes."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, group in groups.items():
        step = max(1, most // n)
        for k in range(0, len(group), step):
            part = group[k : k + step]
            yield np.array(part), [words[i] for i in part]


def train(vocabulary: Vocabulary, counted: dict[str, Counter], rounds: int = 3, smoothing: float = 0.1) -> np.ndarray:
    """Piece probabilities (pieces x languages) from word counts by expectation-maximisation, with additive smoothing.

    The expected count of a piece in a word is what the segmentations with it
    weigh among all: forward times piece times backward, over the word's sum.
    """
    out = []
    for words in counted.values():
        p = np.full((len(vocabulary), 1), 1.0 / len(vocabulary))
        own, weight = list(words), np.array(list(words.values()), float)
        for _ in range(rounds):
            expected = np.full(len(vocabulary), smoothing)
            for index, group in by_length(own):
                lattice = vocabulary.lattice(group)
                n = len(lattice)
                ahead, logs = (x[:, :, 0] for x in sums(lattice, p, len(group), vocabulary.longest))
                # backward sums scaled by the sum of the word: at the scale of the position that a piece starts from they are what it weighs
                behind = np.zeros_like(ahead)
                behind[n] = 1 / ahead[n]
                for start in range(n - 1, -1, -1):
                    for end, hit, piece in lattice[start]:
                        scaled = p[piece, 0] * behind[end, hit] * np.exp(logs[start, hit] - logs[end, hit])
                        behind[start, hit] += scaled
                        np.add.at(expected, piece, ahead[start, hit] * scaled * weight[index[hit]])
            p = (expected / expected.sum())[:, None]
        out.append(p)
    return np.concatenate(out, axis=1) if out else np.zeros((len(vocabulary), 0))


class Scorer(dict):
    """Word numbers by word, with a row of log probabilities for each."""

    def __init__(self, path: str, probabilities: np.ndarray):
        super().__init__()
        self.vocabulary, self.probabilities = Vocabulary(read_pieces(path)), probabilities.astype(float)
        self.rows = np.empty((0, probabilities.shape[1]))
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Log probabilities (texts x languages)."""
        if len(self) > MOST:
            self.clear()
            self.rows = self.rows[:0]
        numbers, out = [], np.zeros((len(texts), self.rows.shape[1]))
        for i, t in enumerate(texts):
            words = words_of(t)
            for w in words:
                if len(w) > CACHED_WORD:
                    out[i] += forward_long(self.vocabulary, self.probabilities, w)
            words = [w for w in words if len(w) <= CACHED_WORD]
            numbers.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        if self.new:
            fresh = np.empty((len(self.new), self.rows.shape[1]))
            for index, group in by_length(self.new):
                fresh[index] = forward(self.vocabulary, self.probabilities, group)
            self.rows, self.new = np.concatenate([self.rows, fresh]), []
        for i, n in enumerate(numbers):
            out[i] += self.rows[n].sum(axis=0)
        return out


_scorers: dict[int, Scorer] = {}


def sample(labelled: DataFrame, text_col: str, lang_col: str, most_rows: int, most_lang: int) -> DataFrame:
    """(lang, text) of a bounded sample: different texts of each language, those with the smallest hashes.

    Copies count once, so that a hot text takes one place. The number of
    different texts of a language is estimated first, so that only about twice
    the sample is ranked.
    """
    rows = labelled.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.where(F.col("text").rlike("\\p{L}")).withColumn("place", F.xxhash64("text"))
    totals = {x.lang: x.n for x in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    most = max(1, min(most_lang, most_rows // max(1, len(totals))))
    # twice the share, as hashes scatter and the number is an estimate
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * most + 50) / max(1, n))))]) if totals else F.create_map(F.lit(""), F.lit(0.0))
    chance = F.pmod("place", F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.where(chance < share[F.col("lang")]).groupBy("lang", "place").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place"))
    return some.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def fit(
    labelled: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", rounds: int = 3, most_rows: int = SAMPLE_ROWS, most_lang: int = SAMPLE_ROWS_LANG
) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, learned on the driver from a bounded sample of labelled rows.

    At most most_rows different texts, spread evenly over the languages, and
    most_lang of each; chosen by a hash of the text, so that tables of equal
    rows in any order give the same model, and repeated rows count once. Rows
    without a language, a text or a letter are not used. Words are learned from
    whole; longer ones than STRETCH bytes, as in languages written without
    spaces, in overlapping stretches that all count. Over MOST_LANGUAGES
    languages raise ValueError, as the model has a number for each piece and
    language (at that bound some 200 MB on each worker). An empty table gives a
    model without languages.
    """
    counted: dict[str, Counter] = {}
    for row in sample(labelled, text_col, lang_col, most_rows, most_lang).toLocalIterator():
        counted.setdefault(row.lang, Counter()).update(s for w in words_of(row.text.encode()) for s in stretches(w))
    # in one order, so that sums are the same each time
    counted = {lang: Counter(dict(sorted(words.items()))) for lang, words in sorted(counted.items()) if words}
    return list(counted), train(Vocabulary(read_pieces(vocabulary)), counted, rounds)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1, the probability among the model's languages for 48 bytes of the text on average).

    Whole texts are scored: the sum over all segmentations of each word into
    pieces of the whole vocabulary. A null text, or one without a letter, or a
    model without languages gives `und` and 0. Equal probabilities give the
    language that comes first by name; repeated rows have equal results.
    Columns of docs with these names (without case) are replaced; an empty
    table gives no rows. The text is the only column that predictions read.
    """
    ship(docs.sparkSession)
    languages, probabilities = model
    probabilities = probabilities.astype(np.float32)
    key = hash((tuple(languages), probabilities.tobytes()))
    sent = docs.sparkSession.sparkContext.broadcast((languages, probabilities))  # vocabulary times MOST_LANGUAGES numbers at most
    rows, own = packed(docs, ("lang_pred", "score"), text=col(text_col))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, table = sent.value
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(vocabulary, table)
        scorer = _scorers[key]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and names_ and has_letter(t)]
            predicted: list[str] = ["und"] * len(texts)
            certain = np.zeros(len(texts))
            lo = held = 0
            for hi, i in enumerate(known, 1):
                held += len(texts[i])
                if held > 2 << 20 or hi == len(known):
                    part = known[lo:hi]
                    coded = [texts[j].encode() for j in part]
                    logs = scorer.scores(coded)
                    bytes_ = np.array([max(SCORED, len(t)) for t in coded])
                    best = logs.argmax(axis=1)
                    scaled = (logs - logs.max(axis=1)[:, None]) * (SCORED / bytes_)[:, None]
                    for j, b, p in zip(part, best, 1 / np.exp(scaled).sum(axis=1), strict=True):
                        predicted[j], certain[j] = names_[b], p
                    lo, held = hi, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(predicted, pa.string()), pa.array(certain)], names=["row", "lang_pred", "score"])

    return rows.mapInArrow(score, schema).select(*unpacked(own), "lang_pred", "score")


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
