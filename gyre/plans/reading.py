"""Queries over pages, prompts and reading measures, and small reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyre.functions import text as X
from gyre.plans.registry import query
from gyre.plans.relational import both
from gyre.plans.text import _SENT, _SYL, _W, _measure, _n, _sent, _syl
from gyre.plans.telemetry import _events, _folded
from gyre.streaming.keyed import MicroBatch, fold

# The conjunctions at which long sentences break, and the targets of a sentence and a word.
CONJUNCTIONS = ("and", "but", "or", "because", "so", "while", "when")
WORDS_PER_SENTENCE, UNITS_PER_WORD = 14, 2
# The gates of page text.
OCR_MIN_CHARS, OCR_IMAGES_PER_1000 = 200, 15

_TRIM = r"E' \t\n\r\x0B\x0C'"


def _trim(c):
    return F.btrim(c, F.lit(X.BLANKS))


# --- gates of page text
both("f9_needs_ocr", f"""WITH p AS (SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', ''))) AS chars, length(html) - length(replace(html, '<img', 'img')) AS images, instr(html, '<svg') > 0 AS drawn FROM {{pages}})
SELECT page_id, CASE WHEN chars < {OCR_MIN_CHARS} THEN images > 0 OR drawn ELSE images * 1e3 / chars > {OCR_IMAGES_PER_1000} END AS needs_ocr FROM p""",
     f"""WITH p AS (SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS chars, length(html) - length(replace(html, '<img', 'img')) AS images, instr(html, '<svg') > 0 AS drawn FROM {{pages}})
SELECT page_id, CASE WHEN chars < {OCR_MIN_CHARS} THEN images > 0 OR drawn ELSE images * 1e3 / chars > {OCR_IMAGES_PER_1000} END AS needs_ocr FROM p""")
both("f10_ocr_accepted", """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM {conversations})
SELECT conv_id, turn, CASE WHEN length(trim(other)) >= floor(length(trim(text)) / 2) THEN other ELSE text END AS chosen FROM t""")
both("f6_book_codes", """WITH c AS (SELECT doc_id, concat(chr(CAST(97 + doc_id % 14 AS INT)), substring('ehux', CAST(doc_id % 4 + 1 AS INT), 1), 'sc', CAST(doc_id % 9 + 1 AS STRING)) AS code FROM {documents}),
v AS (SELECT doc_id, code, regexp_like(code, '^[a-l][ehu][a-z][a-z][0-9]$') AS valid FROM c)
SELECT doc_id, code, CASE WHEN valid THEN ascii(code) - 96 END AS grade, CASE WHEN valid THEN CASE substring(code, 2, 1) WHEN 'e' THEN 'English' WHEN 'h' THEN 'Hindi' ELSE 'Urdu' END END AS medium FROM v""",
     """WITH c AS (SELECT doc_id, concat(chr(CAST(97 + doc_id % 14 AS INT)), substring('ehux', CAST(doc_id % 4 + 1 AS INT), 1), 'sc', CAST(doc_id % 9 + 1 AS STRING)) AS code FROM {documents}),
v AS (SELECT doc_id, code, regexp_matches(code, '^[a-l][ehu][a-z][a-z][0-9]$') AS valid FROM c)
SELECT doc_id, code, CASE WHEN valid THEN ascii(code) - 96 END AS grade, CASE WHEN valid THEN CASE substring(code, 2, 1) WHEN 'e' THEN 'English' WHEN 'h' THEN 'Hindi' ELSE 'Urdu' END END AS medium FROM v""")


def _long_enough(text):
    """Sentences of 40 characters at least; the head of the text if there are none."""
    parts = F.transform(F.split(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), r"([.!?])[ \t\n\r\x0B\f]+", "$1\x01"), "\x01"), _trim)
    found = F.filter(parts, lambda s: F.length(s) >= 40)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.left(text, F.lit(1000))))


_measure("f24_sentences_kept", rf"""len(p) AS n, array_to_string(p, '|') AS kept FROM (SELECT doc_id, CASE WHEN len(f) > 0 THEN f ELSE [left(text, 1000)] END AS p FROM
(SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \t\n\r\x0B\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {_TRIM})), lambda s: length(s) >= 40) AS f FROM documents)) --""",
         n=lambda: F.size(_long_enough(F.col("text"))).cast("long"), kept=lambda: F.array_join(_long_enough(F.col("text")), "|"))

# --- reading measures
_measure("t2_ocr_clean", rf"""trim(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{{3,}}', E'\n\n', 'g'), ' {{2,}}', ' ', 'g'), '\n[0-9]+\n', E'\n', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), {_TRIM}) AS clean""",
         clean=lambda: _trim(F.replace(F.replace(F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), " {2,}", " "), "\n[0-9]+\n", "\n"), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("ﬀ"), F.lit("ff"))))
_measure("t9_sentence_count", f"greatest(1, len(list_filter(string_split_regex(text, '[.!?।॥]+'), lambda s: trim(s, {_TRIM}) <> '')))::BIGINT AS n",
         n=lambda: F.greatest(F.lit(1), F.size(F.filter(F.split("text", "[.!?।॥]+"), lambda s: _trim(s) != ""))).cast("long"))
_measure("t16_reading_load", f"round(w::DOUBLE / s / {WORDS_PER_SENTENCE} + y::DOUBLE / w / {UNITS_PER_WORD}, 5) AS load FROM (SELECT doc_id, greatest(1, len({_W})) AS w, {_SENT} AS s, coalesce({_SYL}, 0) AS y FROM documents) --",
         load=lambda: F.round(_n() / _sent() / WORDS_PER_SENTENCE + _syl() / _n() / UNITS_PER_WORD, 5))


def _syllables_e(word):
    """Vowel groups with y, one less for any final e, 1 at least; 0 for a word of punctuation."""
    w = F.btrim(F.lower(word), F.lit(".,!?;:"))
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - w.endswith("e").cast("int")))


_measure("t18_syllables_final_e", f"coalesce(list_sum(list_transform(list_transform({_W}, lambda w: trim(lower(w), '.,!?;:')), lambda w: CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - ends_with(w, 'e')::INT) END)), 0)::BIGINT AS n",
         n=lambda: F.coalesce(X.total(F.transform(X.words(F.col("text")), lambda w: _syllables_e(w).cast("long"))), F.lit(0).cast("long")))


def _broken(text):
    """Sentences of over 25 words broken at conjunctions."""
    at = X.re2(rf"(?i)\b({'|'.join(CONJUNCTIONS)})\b")
    capital = lambda p: F.when(p.rlike(r"^\p{Lu}"), p).otherwise(F.concat(X.upper_letter(F.left(p, F.lit(1))), X.lower_of(F.substr(p, F.lit(2)))))
    parts = lambda s: F.transform(F.filter(F.transform(F.split(s, at), _trim), lambda p: p != ""), capital)
    return F.concat(F.array_join(F.flatten(F.transform(X.sentences(text), lambda s: F.when(F.size(X.words(s)) <= 25, F.array(s)).otherwise(parts(s)))), ". "), F.lit("."))


_measure("t24_broken_sentences", rf"""array_to_string(flatten(list_transform(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, {_TRIM})), lambda s: s <> ''),
  lambda s: CASE WHEN len({_W.replace('(text', '(s')}) <= 25 THEN [s] ELSE list_transform(list_filter(list_transform(string_split_regex(s, '(?i)\b({'|'.join(CONJUNCTIONS)})\b'), lambda p: trim(p, {_TRIM})), lambda p: p <> ''),
  lambda p: CASE WHEN regexp_matches(p, '^\p{{Lu}}') THEN p ELSE upper(left(p, 1)) || lower(substr(p, 2)) END) END)), '. ') || '.' AS simple""",
         simple=lambda: _broken(F.col("text")))
_measure("t26_script_language", "CASE " + " ".join(f"WHEN len(regexp_extract_all(text, '[{a}-{b}]'))::DOUBLE / greatest(1, length(text)) > 0.3 THEN '{c}'" for a, b, c in (("ऀ", "ॿ", "hi"), ("ঀ", "৿", "bn"), ("஀", "௿", "ta"), ("ఀ", "౿", "te"))) + " ELSE 'en' END AS detected",
         detected=lambda: F.expr("CASE " + " ".join(f"WHEN regexp_count(text, '[{a}-{b}]') / greatest(1, length(text)) > 0.3 THEN '{c}'" for a, b, c in (("ऀ", "ॿ", "hi"), ("ঀ", "৿", "bn"), ("஀", "௿", "ta"), ("ఀ", "౿", "te"))) + " ELSE 'en' END"))


def _ended(text):
    """Without an unfinished last sentence, if it starts in the last three tenths."""
    out = text
    for mark in reversed((". ", "! ", "? ", "। ")):
        r = F.instr(F.reverse(text), mark[::-1])
        out = F.when((r > 0) & (F.length(text) - r - 1 > F.length(text) * 0.7), F.left(text, F.length(text) - r)).otherwise(out)
    return F.when(F.rtrim(text).rlike(r"[.!?।]\z"), text).otherwise(out)


_measure("t62_clean_ending", r"CASE WHEN regexp_matches(rtrim(text), '[.!?।]\z') THEN text " + " ".join(f"WHEN instr(reverse(text), '{m[::-1]}') > 0 AND length(text) - instr(reverse(text), '{m[::-1]}') - 1 > length(text) * 0.7::DOUBLE THEN left(text, length(text) - instr(reverse(text), '{m[::-1]}'))" for m in (". ", "! ", "? ", "। ")) + " ELSE text END AS ended",
         ended=lambda: _ended(F.col("text")))


def _found_by_type():
    """How often each pattern of the policy is found, in a text that the ones before have redacted already: as SQL, and as columns."""
    sql, columns, before = [], {}, "text"
    for k, (pattern, name) in enumerate(X.REDACTIONS):
        p = pattern.replace("'", "''")
        sql.append(f"len(regexp_extract_all({before}, '{p}'))::BIGINT AS {name.lower()}")
        before = f"regexp_replace({before}, '{p}', '[REDACTED_{name}]', 'g')"
        columns[name.lower()] = lambda k=k: F.regexp_count(X.redacted(F.col("text"), k), F.lit(X.re2(X.REDACTIONS[k][0]))).cast("long")
    return ", ".join(sql), columns


_FOUND_SQL, _FOUND = _found_by_type()
_measure("t43_policy_counts", _FOUND_SQL, **_FOUND)

# A Devanagari sign for each Latin letter: letters, vowel signs, a virama (h) and an anusvara (n).
_SIGNS = "ाबचदेफग्िजकलमंोपखरसतुवथषयझ"
_LETTERS_AZ = "abcdefghijklmnopqrstuvwxyz"


@query("t11_aksharas", rf"""SELECT word, array_to_string(CASE WHEN regexp_matches(word, '[ऀ-ॿ]') THEN regexp_extract_all(word, '[^\p{{M}}\s](?:\p{{M}}*्[^\p{{M}}\s])*\p{{M}}*|\p{{M}}+') ELSE [word] END, '|') AS units
FROM (SELECT DISTINCT translate(lower(word), '{_LETTERS_AZ}', '{_SIGNS}') AS word FROM (SELECT unnest({_W}) AS word FROM documents) WHERE regexp_full_match(lower(word), '[a-z]+'))""")
def t11(spark, sf_dir):
    """The words of all documents that are of Latin letters alone, spelled letter by letter in Devanagari, as the tables hold no Brahmic script; then taken apart into aksharas."""
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.array_distinct(X.words(F.lower("text")))).alias("word")).where(F.col("word").rlike("^[a-z]+$"))
    w = F.col("word")
    units = F.when(w.rlike("[ऀ-ॿ]"), X.aksharas(w, X.VIRAMAS["Devanagari"])).otherwise(F.array(w))
    return words.select(F.translate("word", _LETTERS_AZ, _SIGNS).alias("word")).distinct().select("word", F.array_join(units, "|").alias("units"))


@query("k11_hardest_words", rf"""WITH w AS (SELECT DISTINCT doc_id, unnest({_W}) AS word FROM documents), u AS (SELECT doc_id, word, len(regexp_extract_all(lower(word), '[aeiouy]+')) AS units FROM w)
SELECT doc_id, word, units FROM u WHERE units >= 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY units DESC, word) <= 8""")
def k11(spark, sf_dir):
    """Eight words of four units at least, by units and word; within the row, so that nothing is shuffled."""
    hard = F.transform(F.array_distinct(X.words(F.col("text"))), lambda w: F.struct((-F.regexp_count(F.lower(w), F.lit("[aeiouy]+"))).alias("less"), w.alias("word")))
    top = F.slice(F.array_sort(F.filter(hard, lambda h: h["less"] <= -4)), 1, 8)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.inline(top))
    return d.select("doc_id", "word", (-F.col("less")).cast("long").alias("units"))


# --- prompts, prefixes, reports
both("t64_prompt", "SELECT conv_id, turn, concat('Question: ', text, ' | Role: ', role) AS prompt FROM {conversations}")
both("a15_mean_alignment", "SELECT d.source, round(avg(l.quality), 6) AS alignment, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source")
both("a37_ensemble_mean", "SELECT doc_id, (quality + 1e0 - toxic) / 2e0 AS score FROM {labels}")
both("m15_wilson", """WITH g AS (SELECT d.lang, count(*) AS n, sum(l.quality) * 1e0 / count(*) AS p FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL GROUP BY d.lang),
s AS (SELECT lang, p, 1e0 + 3.8416e0 / n AS d, p + 3.8416e0 / (2e0 * n) AS c, 1.96e0 * sqrt(p * (1e0 - p) / n + 3.8416e0 / (4e0 * n * n)) AS h FROM g)
SELECT lang, round(p, 6) AS p, round(greatest(0e0, (c - h) / d), 6) AS low, round(least(1e0, (c + h) / d), 6) AS high FROM s""")
both("m4_cleanup", "SELECT event_type, count(*) AS kept FROM {events} WHERE ts >= timestamp_ntz '2024-01-29 00:00:00' GROUP BY event_type", "SELECT event_type, count(*) AS kept FROM {events} WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY event_type")
both("w1_group_top3_sum", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM {events} WHERE value >= 0.35) SELECT user_id, round(sum(value), 4) AS score FROM r WHERE k <= 3 GROUP BY user_id")
both("w4_chunk_index", r"SELECT doc_id, pos AS chunk_index, length(line) AS n FROM {documents} LATERAL VIEW posexplode(split(text, '\n')) t AS pos, line",
     "SELECT doc_id, (k - 1)::INT AS chunk_index, length(parts[k])::INT AS n FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {documents}))")
both("k3_array_topk", "SELECT vec_id, CAST(s[0] AS DOUBLE) AS a, CAST(s[1] AS DOUBLE) AS b, CAST(s[2] AS DOUBLE) AS c FROM (SELECT vec_id, sort_array(embedding, false) AS s FROM {embeddings}) x",
     "SELECT vec_id, s[1]::DOUBLE AS a, s[2]::DOUBLE AS b, s[3]::DOUBLE AS c FROM (SELECT vec_id, list_reverse_sort(embedding) AS s FROM {embeddings}) x")
both("s23_key_lookup", "SELECT e.vec_id, e.label FROM {embeddings} e WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = e.vec_id)")
both("s28_delete_documents", "SELECT d.doc_id, d.source FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")


@query("j15_longest_prefix", f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT DISTINCT array_to_string(w[1:k], ' ') AS prefix, k FROM d, (VALUES (1), (3), (5)) AS v(k) WHERE doc_id % 2 = 0 AND len(w) >= k)
SELECT d.doc_id, max(c.k)::INT AS matched FROM d JOIN c ON len(d.w) >= c.k AND array_to_string(d.w[1:c.k], ' ') = c.prefix GROUP BY d.doc_id""")
def j15(spark, sf_dir):
    """Prefixes of 1, 3 and 5 words of the even documents are cached; every document asks. An equi-join on the prefixes."""
    w = X.words(F.col("text"))
    prefixes = F.explode(F.filter(F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("prefix"))), lambda p: F.size("w") >= p["k"]))
    asked = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", w.alias("w")).select("doc_id", prefixes.alias("p")).select("doc_id", "p.k", "p.prefix")
    cached = asked.where("doc_id % 2 = 0").select("k", "prefix").distinct()
    return asked.join(cached, ["k", "prefix"], "left_semi").groupBy("doc_id").agg(F.max("k").alias("matched"))


@query("m10_json_salvage", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def m10(spark, sf_dir):
    """The object in a response with text around it; null if there is none."""
    response = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" Done."))
    found = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object(found, "$.k").cast("int").alias("k"))


#: An event and whether it opens a batch.
ST8 = _folded("user_id", "1 AS held, s AS since, true AS ok", "CASE WHEN r.held = 4 OR e.s - r.since >= 86400 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held = 4 OR e.s - r.since >= 86400 THEN e.s ELSE r.since END, r.held = 4 OR e.s - r.since >= 86400", "ok")


@query("st8_micro_batches", ST8)
def st8(spark, sf_dir):
    return fold(_events(spark, sf_dir), lambda: MicroBatch(4, 86400.0), "user_id", "s", "event_id", "failed")
