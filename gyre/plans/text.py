"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyre.functions import text as X
from gyre.plans.registry import query
from gyre.session import materialize, ship, sized, spread, table

_W = r"list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _measure(name, sql, **columns):
    """A query of document measures: functions that give the columns by name, and their SQL."""

    @query(name, f"SELECT doc_id, {sql} FROM documents")
    def run(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", *[c().alias(k) for k, c in columns.items()])


_measure("t8_sentences", r"len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \t\n\r\x0B\x0C')), lambda s: s <> ''))::INT AS n", n=lambda: F.size(X.sentences(F.col("text"))))
_measure("t12_latin_syllables", rf"""list_sum(list_transform({_W}, lambda w: CASE WHEN regexp_replace(lower(w), '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[aeiouy]+'))
  - (CASE WHEN regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), 'e$') AND NOT regexp_matches(regexp_replace(lower(w), '[^a-z]', '', 'g'), '(le|ee)$') AND len(regexp_extract_all(regexp_replace(lower(w), '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)) END))::BIGINT AS n""",
         n=lambda: X.total(F.transform(X.words(F.col("text")), lambda w: X.latin_syllables(w).cast("long"))))
_measure("t19_syllables_simple", f"list_sum(list_transform({_W}, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(lower(w), '[aeiou]+')) - (CASE WHEN ends_with(lower(w), 'e') THEN 1 ELSE 0 END)) END))::BIGINT AS n",
         n=lambda: X.total(F.transform(X.words(F.col("text")), lambda w: X.syllables_simple(w).cast("long"))))
_SYL = rf"""list_sum(list_transform({_W}, lambda w: CASE WHEN length(regexp_replace(lower(w), '^[.,!?;:"]+|[.,!?;:"]+$', '', 'g')) < 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(w), '^[.,!?;:"]+|[.,!?;:"]+$', '', 'g'), '[aeiou]+'))
  - (CASE WHEN ends_with(regexp_replace(lower(w), '^[.,!?;:"]+|[.,!?;:"]+$', '', 'g'), 'e') AND len(regexp_extract_all(regexp_replace(lower(w), '^[.,!?;:"]+|[.,!?;:"]+$', '', 'g'), '[aeiou]+')) > 1 THEN 1 ELSE 0 END)) END))"""


def _syl():
    return X.total(F.transform(X.words(F.col("text")), lambda w: X.syllables_stripped(w).cast("long")))


_measure("t20_syllables_stripped", f"{_SYL}::BIGINT AS n", n=lambda: _syl())
_SENT = r"greatest(1, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \t\n\r\x0B\x0C')), lambda s: s <> '')))"


def _sent():
    return F.greatest(F.lit(1), F.size(X.sentences(F.col("text"))))


def _n():
    return F.greatest(F.lit(1), F.size(X.words(F.col("text"))))


_measure("t17_readability", f"round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (w::DOUBLE / s) - 84.6::DOUBLE * (y::DOUBLE / w))), 5) AS ease, round(greatest(0.0::DOUBLE, 0.39::DOUBLE * (w::DOUBLE / s) + 11.8::DOUBLE * (y::DOUBLE / w) - 15.59::DOUBLE), 5) AS grade FROM (SELECT doc_id, greatest(1, len({_W})) AS w, {_SENT} AS s, coalesce({_SYL}, 0) AS y FROM documents) --",
         ease=lambda: F.round(X.flesch(_n(), _sent(), _syl()), 5), grade=lambda: F.round(X.kincaid(_n(), _sent(), _syl()), 5))
_measure("t22_complex_words", f"len(list_distinct(list_filter({_W}, lambda w: length(w) > 10)))::INT AS n", n=lambda: F.size(F.array_distinct(F.filter(X.words(F.col("text")), lambda w: F.length(w) > 10))))
_measure("t27_script_share", r"round(len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / greatest(1, len(regexp_extract_all(text, '\p{L}'))), 6) AS share", share=lambda: F.round(F.regexp_count(F.col("text"), F.lit("[A-Za-z]")) / F.greatest(F.lit(1), F.regexp_count(F.col("text"), F.lit(r"\p{L}"))), 6))
_measure("t40_redacted", r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'AKIA[0-9A-Z]{16}', '[REDACTED_AWS_KEY]', 'g'), 'sk-[A-Za-z0-9]{48}', '[REDACTED_OPENAI_KEY]', 'g'), 'ghp_[A-Za-z0-9]{36}', '[REDACTED_GITHUB_TOKEN]', 'g'),
  '(?i)(password|passwd|pwd)["'']?\s*[:=]\s*["'']?([^\s"'']{8,})', '[REDACTED_PASSWORD]', 'g'), 'eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*', '[REDACTED_JWT]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[REDACTED_SSN]', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[REDACTED_EMAIL]', 'g') AS redacted""",
         redacted=lambda: X.redacted(F.col("text")))
_measure("t28_malformed_maths", r"regexp_matches(text, '\$[^$]*$') AND (length(text) - length(replace(text, '$', ''))) % 2 = 1 AS malformed", malformed=lambda: F.col("text").rlike(r"\$[^$]*\z") & ((F.length("text") - F.length(F.replace("text", F.lit("$"), F.lit("")))) % 2 == 1))
_measure("t70_extractive_answer", r"array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s: trim(s, E' \t\n\r\x0B\x0C')), lambda s: s <> '')[1:3], '. ') AS answer",
         answer=lambda: F.array_join(F.slice(F.filter(F.transform(F.split(F.col("text"), r"\."), lambda s: F.btrim(s, F.lit(X.BLANKS))), lambda s: s != ""), 1, 3), ". "))
_measure("f23_prose", rf"len({_W}) >= 8 AND len(regexp_extract_all(text, '[0-9]'))::DOUBLE / greatest(1, length(text)) < 0.25 AS prose", prose=lambda: (F.size(X.words(F.col("text"))) >= 8) & (F.regexp_count(F.col("text"), F.lit("[0-9]")) / F.greatest(F.lit(1), F.length("text")) < 0.25))
_measure("m11_hashes", "md5(text) AS md5, sha256(text) AS sha256", md5=lambda: F.md5("text"), sha256=lambda: F.sha2("text", 256))
_measure("m17_url_build", "'https://books.example/' || source || lpad((doc_id % 20)::VARCHAR, 2, '0') || '.pdf' AS url", url=lambda: F.format_string("https://books.example/%s%02d.pdf", "source", F.col("doc_id") % 20))


@query("u3_jaccard", f"""WITH d AS (SELECT doc_id, list_distinct({_W}) AS w FROM documents), p AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""")
def u3(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", X.words(F.col("text")).alias("w"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("y"))
    return d.join(nxt, "doc_id").select("doc_id", F.round(X.jaccard(F.col("w"), F.col("y")), 6).alias("jaccard"))


@query("t34_word_grounding", f"""WITH c AS (SELECT conv_id, turn, role, list_distinct({_W}) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(a.w) END, 6) AS grounding FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'""")
def t34(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.words(F.col("text")).alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("context"))
    return c.where("role = 'assistant'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.covered(F.col("w"), F.col("context")), 6).alias("grounding"))


@query("t58_keyword_rank", rf"""WITH q AS (SELECT DISTINCT unnest({_W.replace('(text', '(lower(text)')}) AS w FROM benchmark), t AS (SELECT doc_id, lower(unnest({_W})) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS n FROM t SEMI JOIN q USING (w) GROUP BY ALL), df AS (SELECT w, count(*) AS d FROM tf GROUP BY w),
s AS (SELECT tf.doc_id, sum(tf.n * ln((SELECT count(*) FROM documents)::DOUBLE / df.d)) AS score FROM tf JOIN df USING (w) GROUP BY tf.doc_id)
SELECT doc_id, round(coalesce(score, 0), 4) + 0.0 AS score FROM documents LEFT JOIN s USING (doc_id)""")
def t58(spark, sf_dir):
    """The words of the benchmark items as the question, whatever number of documents has them; tf-idf by an inverted index.

    Texts are split once: their counts of the asked words, and the number of
    documents, come from one written table. Every document has a row, with 0 if
    it has none of the words.
    """
    asked = materialize(table(spark, sf_dir, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("w")).distinct(), "asked")
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.explode_outer(X.words(F.lower("text"))).alias("w"))
    # each document's row without a word stays, with a count of 0
    hits = docs.join(sized(asked.withColumn("asked", F.lit(1))), "w", "left")
    tf = hits.groupBy("doc_id", F.when(F.col("asked") == 1, F.col("w")).alias("w")).agg(F.count("asked").alias("n"))
    tf = materialize(tf, "postings")
    n = tf.select("doc_id").distinct().count()
    df = materialize(tf.where("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("d")), "frequencies")
    scored = tf.join(sized(df), "w", "left").select("doc_id", F.coalesce(F.col("n") * F.log(F.lit(float(n)) / F.col("d")), F.lit(0.0)).alias("x"))
    return scored.groupBy("doc_id").agg((F.round(F.sum("x"), 4) + 0.0).alias("score"))


_RFIND = "length(part) - instr(reverse(part), {}) "
_CUT = rf"""CASE WHEN begin_ + 1200 >= n THEN n WHEN contains(part, chr(10) || chr(10)) THEN CASE WHEN floor + {_RFIND.format("chr(10) || chr(10)")} - 1 > floor THEN floor + {_RFIND.format("chr(10) || chr(10)")} - 1 ELSE begin_ + 1200 END
  ELSE greatest({", ".join(f"CASE WHEN contains(part, '{e}') THEN floor + " + _RFIND.format(f"'{e[::-1]}'") + f" ELSE begin_ + 1200 - 100000000 END" for e in (". ", "? ", "! ", "। "))}) END"""
_NEXT = "CASE WHEN c.k = 0 THEN 0 ELSE greatest(c.begin_ + 1, c.stop - 200) END"


@query("t3_chunks", f"""WITH RECURSIVE d AS (SELECT doc_id, trim(text, E' \t\n\r\x0B\x0C') AS t FROM documents),
c AS (SELECT doc_id, 0::BIGINT AS begin_, 0::BIGINT AS stop, 0 AS k FROM d WHERE length(t) > 0
UNION ALL SELECT doc_id, begin_, CASE WHEN cut < 0 THEN begin_ + 1200 ELSE cut END AS stop, k FROM (SELECT doc_id, begin_, {_CUT} AS cut, k FROM (SELECT c.doc_id, length(d.t) AS n, c.k + 1 AS k, {_NEXT} AS begin_, {_NEXT} + 900 AS floor, substr(d.t, {_NEXT} + 901, 300) AS part FROM c JOIN d ON d.doc_id = c.doc_id WHERE c.k = 0 OR c.stop < length(d.t)))),
p AS (SELECT c.doc_id, c.k, trim(substr(d.t, begin_ + 1, stop - begin_), E' \t\n\r\x0B\x0C') AS chunk FROM c JOIN d ON d.doc_id = c.doc_id WHERE c.k > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS chunk_index, chunk FROM p WHERE length(chunk) >= 120""")
def t3(spark, sf_dir):
    ship(spark)
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.posexplode(X.chunker()("text")).alias("chunk_index", "chunk"))


_ONE_BREAK = r"'([^\n])\n([^\n])', '\1 \2', 'g'"


@query("t1_cleaned", rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), {_ONE_BREAK}), {_ONE_BREAK}), '^\n([^\n])|([^\n])\n$', '\2 \1'), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS clean FROM documents""")
def t1(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.cleaned(F.col("text")).alias("clean"))


_LETTERS = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
_LATIN_UNITS = rf"""list_transform({_W}, lambda w: CASE WHEN {_LETTERS} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({_LETTERS}, '[aeiouy]+')) - (regexp_matches({_LETTERS}, 'e$') AND NOT regexp_matches({_LETTERS}, '(le|ee)$') AND len(regexp_extract_all({_LETTERS}, '[aeiouy]+')) > 1)::INT) END)"""


@query("t14_measure", rf"""WITH m AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'Latin' ELSE 'Unknown' END AS script, greatest(1, len(list_filter(string_split_regex(text, '[.!?।॥]+[ \t\n\x0B\f\r]|[.!?।॥]+$'), lambda s: trim(s) <> '')))::INT AS sentences, len({_W})::INT AS words, {_LATIN_UNITS} AS u FROM documents),
c AS (SELECT doc_id, script, sentences, words, coalesce(list_sum(u), 0)::BIGINT AS units, len(list_filter(u, lambda n: n >= 4))::INT AS long_words FROM m)
SELECT *, words::DOUBLE / sentences AS words_per_sentence, CASE WHEN words > 0 THEN units::DOUBLE / words END AS units_per_word, CASE WHEN words > 0 THEN long_words::DOUBLE / words END AS long_word_ratio FROM c""")
def t14(spark, sf_dir):
    """In steps, so that nothing is computed twice: letters of each word, its vowel groups, its units, then their counts."""
    d = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    letters = F.transform(X.words(F.col("text")), lambda w: F.regexp_replace(F.lower(w), "[^a-z]", ""))
    d = d.select("doc_id", X.script(F.col("text")).alias("script"), X.sentence_count(F.col("text")).alias("sentences"), letters.alias("letters"))
    d = d.select("doc_id", "script", "sentences", "letters", F.transform("letters", lambda w: F.regexp_count(w, F.lit("[aeiouy]+"))).alias("groups"))
    units = F.zip_with("letters", "groups", lambda w, n: F.when(w == "", 0).otherwise(F.greatest(F.lit(1), n - (w.endswith("e") & ~w.endswith("le") & ~w.endswith("ee") & (n > 1)).cast("int"))))
    d = d.select("doc_id", "script", "sentences", units.alias("u"))
    d = d.select("doc_id", "script", "sentences", F.size("u").alias("words"), X.total(F.transform("u", lambda n: n.cast("long"))).alias("units"), F.size(F.filter("u", lambda n: n >= 4)).alias("long_words"))
    return d.withColumns({"words_per_sentence": F.col("words") / F.col("sentences"), "units_per_word": F.expr("try_divide(units, words)"), "long_word_ratio": F.expr("try_divide(long_words, words)")})


_PLAIN = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"
_CLAMP = "least(greatest({}, 0.0::DOUBLE), 1.0::DOUBLE)"


@query("t21_complexity", rf"""WITH m AS (SELECT doc_id, {_PLAIN} AS o, len(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \t\n\r\x0B\x0C')), lambda s: s <> '')) AS s FROM documents),
c AS (SELECT doc_id, len(o) AS n, s, list_sum(list_transform(o, lambda w: length(w))) AS chars, list_sum(list_transform(o, lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(w, '[aeiou]+')) - ends_with(w, 'e')::INT) END)) AS units FROM m)
SELECT doc_id, CASE WHEN n > 0 AND s > 0 THEN round(0.4::DOUBLE * {_CLAMP.format('(n::DOUBLE / s - 5) / 25')} + 0.3::DOUBLE * {_CLAMP.format('(chars::DOUBLE / n - 3) / 7')} + 0.3::DOUBLE * {_CLAMP.format('(units::DOUBLE / n - 1) / 3')}, 6) ELSE 0.0 END::DOUBLE AS complexity FROM c""")
def t21(spark, sf_dir):
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.round(X.complexity(F.col("text")), 6).alias("complexity"))


@query("t46_direct_quote", f"""WITH b AS (SELECT list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM (SELECT {_W} AS w FROM benchmark) WHERE len(w) >= 5), g AS (SELECT DISTINCT unnest(g) AS g FROM b),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents)))
SELECT doc_id, count(*) AS quoted FROM d JOIN g USING (g) GROUP BY doc_id""")
def t46(spark, sf_dir):
    """Only 5-grams that the benchmark has are made distinct; the others of the documents never leave their task if these are few."""
    grams = lambda df, *c: df.select(*c, X.words(F.col("text")).alias("w")).where("size(w) >= 5").select(*c, F.explode(F.expr("transform(sequence(1, size(w) - 4), i -> array_join(slice(w, i, 5), ' '))")).alias("g"))
    sought = materialize(grams(table(spark, sf_dir, "benchmark")).distinct(), "sought")
    found = grams(spread(_docs(spark, sf_dir).select("doc_id", "text")), "doc_id").join(sized(sought), "g", "left_semi").distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("quoted"))
