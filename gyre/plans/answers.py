"""Queries over answers and their sources, filters with probes, searches in two steps, and tables that are written and read again.

A document stands for an answer, the next one by id for its source.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gyre.functions import answers as A
from gyre.functions import text as X
from gyre.functions import vectors as V
from gyre.operators.retrieval import reranked
from gyre.plans.registry import query
from gyre.plans.relational import both
from gyre.plans.text import _W, _docs, _measure
from gyre.plans.vectors import _COS, _COS_Q, _VEC, _asked, _embeddings, _topk_sql
from gyre.session import fresh_path, materialize, ship, sized, spread, table
from gyre.sources import corpus
from gyre.sources.store import Store

_PAIR = "pair AS (SELECT a.doc_id, a.text, b.text AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"


def _pairs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", "text").join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


def _of_pairs(name, sql, **columns):
    """A query of measures of a document and the next one."""

    @query(name, f"WITH {_PAIR} SELECT doc_id, {sql} FROM pair")
    def run(spark, sf_dir):
        return _pairs(spark, sf_dir).select("doc_id", *[c().alias(k) for k, c in columns.items()])


def _words(column):
    return _W.replace("text", f"lower({column})", 1)


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _set(column, without=(), least=1):
    kept = f"list_distinct(list_filter({_words(column)}, lambda w: length(w) >= {least}))"
    return f"list_filter({kept}, lambda w: NOT list_contains({_list(without)}, w))" if without else kept


# --- answers and sources
_G, _GS = _set("text", A.GROUNDING_STOPWORDS), _set("other", A.GROUNDING_STOPWORDS)
_of_pairs("t35_grounding", f"round(CASE WHEN len({_G}) = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, len(list_intersect({_G}, {_GS}))::DOUBLE / len({_G}) * 1.2::DOUBLE) END, 6) AS grounding",
          grounding=lambda: F.round(A.grounding(F.col("text"), F.col("other")), 6))
_Q, _QA = _set("text", A.MATCH_STOPWORDS, 3), _set("other", A.MATCH_STOPWORDS, 3)
_of_pairs("t36_question_match", f"round(CASE WHEN len({_Q}) > 0 AND len({_QA}) > 0 THEN least(1.0::DOUBLE, len(list_intersect({_Q}, {_QA}))::DOUBLE / greatest(1.0::DOUBLE, len({_Q}) * 0.3::DOUBLE)) ELSE 0.8::DOUBLE END, 6) AS similarity",
          similarity=lambda: F.round(A.question_match(F.col("text"), F.col("other")), 6))
_CONTRA = " + ".join(f"(contains(lower(text), '{a}') AND contains(lower(text), '{b}'))::INT" for a, b in A.CONTRADICTIONS)
_UNSUP = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in A.UNSUPPORTED)
_measure("t37_consistency", f"({_CONTRA})::INT AS contradictions, ({_UNSUP})::INT AS claims, greatest(0.0::DOUBLE, round(1 - 0.2::DOUBLE * ({_CONTRA} + ({_UNSUP} > 0)::INT), 6)) AS score",
         contradictions=lambda: A.contradictions(F.col("text")), claims=lambda: A.unsupported(F.col("text")).cast("int"),
         score=lambda: F.greatest(F.lit(0.0), F.round(1 - 0.2 * (A.contradictions(F.col("text")) + (A.unsupported(F.col("text")) > 0).cast("int")), 6)))
both("t39_overall_verdict", """SELECT l.doc_id, m.mode, CASE WHEN m.mode = 'strict' THEN l.toxic = 0 AND l.quality = 1 ELSE l.toxic = 0 END AS passed,
CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'blocked' WHEN m.mode = 'strict' AND (l.toxic = 1 OR l.quality = 0) THEN 'review' WHEN l.toxic = 1 THEN 'review' WHEN m.mode = 'balanced' AND l.quality = 0 THEN 'caution' ELSE 'safe' END AS level
FROM {labels} l CROSS JOIN (VALUES ('strict'), ('balanced'), ('permissive')) AS m(mode)""")
_of_pairs("t57_heuristic_scores", f"""CASE WHEN length(other)::DOUBLE / greatest(1, length(text)) BETWEEN 0.3 AND 1.5 THEN 8.0::DOUBLE ELSE 6.0::DOUBLE END AS factual,
CASE WHEN abs(len({_words('other')})::DOUBLE / (length(other) - length(replace(other, '.', '')) + 1) - (9 + doc_id % 12)) <= 5 THEN 8.5::DOUBLE WHEN abs(len({_words('other')})::DOUBLE / (length(other) - length(replace(other, '.', '')) + 1) - (9 + doc_id % 12)) <= 10 THEN 7.0::DOUBLE ELSE 6.0::DOUBLE END AS clarity,
round(5 + 5 * len(list_intersect({_set("text")}, {_set("other")}))::DOUBLE / greatest(1, len({_set("text")})), 6) AS completeness""",
          factual=lambda: F.when((F.length("other") / F.greatest(F.lit(1), F.length("text"))).between(0.3, 1.5), 8.0).otherwise(6.0),
          clarity=lambda: F.when(_off_target() <= 5, 8.5).when(_off_target() <= 10, 7.0).otherwise(6.0),
          completeness=lambda: F.round(5 + 5 * F.size(F.array_intersect(A.word_set(F.col("text")), A.word_set(F.col("other")))) / F.greatest(F.lit(1), F.size(A.word_set(F.col("text")))), 6))


def _off_target():
    """How far the mean sentence is from the length that suits the grade, 8 words and the grade."""
    stops = F.length("other") - F.length(F.replace("other", F.lit("."), F.lit("")))
    return F.abs(F.size(X.words(F.col("other"))) / (stops + 1) - (9 + F.col("doc_id") % 12))


_TERMS = " + ".join(f"contains(lower(text), '{t}')::INT" for t in A.SCIENCE_TERMS)
_of_pairs("t31_terminology", f"({_TERMS})::INT AS terms, ({_TERMS}) = 0 OR len(list_filter({_words('other')}, lambda w: length(w) > 6))::DOUBLE / greatest(1, len({_words('other')})) > 0.1 AS preserved",
          terms=lambda: sum((F.lower("text").contains(t).cast("int") for t in A.SCIENCE_TERMS), F.lit(0)),
          preserved=lambda: (sum((F.lower("text").contains(t).cast("int") for t in A.SCIENCE_TERMS), F.lit(0)) == 0) | (F.size(F.filter(X.words(F.lower("other")), lambda w: F.length(w) > 6)) / F.greatest(F.lit(1), F.size(X.words(F.lower("other")))) > 0.1))


@query("t55_relevance", f"""WITH near AS (SELECT a.doc_id, a.text, b.text AS other FROM documents a JOIN (SELECT doc_id, text, unnest(range(1, 6)) AS o FROM documents) b ON a.doc_id = b.doc_id - b.o),
s AS (SELECT doc_id, least(1.0::DOUBLE, 2 * len(list_intersect({_set("text")}, {_set("other")}))::DOUBLE / greatest(1, len({_set("text")}))) AS x FROM near) SELECT doc_id, round(avg(x), 6) AS relevance FROM s GROUP BY doc_id""")
def t55(spark, sf_dir):
    """Each document against the five next ones: mean of twice the share of its words that they have, 1 at most.

    Documents meet in runs of 64 ids, and only the first five of a run go to
    the one before as well, so that words are moved about once; they move as a
    text, which is smaller than an array.
    """
    own = spread(_docs(spark, sf_dir).select("doc_id", "text")).where("doc_id IS NOT NULL").select("doc_id", F.array_join(A.word_set(F.col("text")), " ").alias("ws"))
    run = lambda i: i - F.pmod(i, F.lit(64))
    runs = own.withColumn("run", F.explode(F.array_distinct(F.array(run(F.col("doc_id")), run(F.col("doc_id") - 5)))))
    near = F.collect_list(F.struct(F.col("ws").alias("v"))).over(Window.partitionBy("run").orderBy("doc_id").rangeBetween(1, 5))
    pairs = runs.withColumn("near", near).where(F.col("run") == run(F.col("doc_id"))).select("doc_id", _unjoined("ws").alias("w"), F.explode("near.v").alias("v"))
    share = 2 * F.size(F.array_intersect("w", _unjoined("v"))) / F.greatest(F.lit(1), F.size("w"))
    return pairs.groupBy("doc_id").agg(F.round(F.avg(F.least(F.lit(1.0), share)), 6).alias("relevance"))


def _unjoined(words):
    """The words that were joined by blanks."""
    return F.when(F.col(words) == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


# --- questions
_HITS = {k: " + ".join(f"contains(lower(text), '{p}')::INT" for p in v) for k, v in A.INTENTS.items()}
_MOST = f"greatest({', '.join(_HITS.values())})"
_CASES = " ".join(f"WHEN {h} = {_MOST} THEN '{k}'" for k, h in _HITS.items())


@query("t51_intent", f"SELECT conv_id, turn, CASE WHEN {_MOST} = 0 THEN 'conversational' {_CASES} END AS intent, round(CASE WHEN {_MOST} = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, ({_MOST}) / 3.0::DOUBLE) END, 6) AS confidence FROM conversations WHERE role = 'user'")
def t51(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", A.intent(F.col("text")).alias("i"))
    return asked.select("conv_id", "turn", "i.intent", F.round("i.confidence", 6).alias("confidence"))


@query("t56_reformulated", f"SELECT conv_id, turn, {_list(A.REFORMULATIONS)}[(turn % 4 + 1)::INT] || text AS asked FROM conversations WHERE role = 'user'")
def t56(spark, sf_dir):
    template = F.element_at(F.array(*[F.lit(t) for t in A.REFORMULATIONS]), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(template, "text").alias("asked"))


_measure("t61_cut_at_sentence", r"CASE WHEN regexp_matches(text, '[.!?]') THEN regexp_extract(text, '(?s)^.*[.!?]') ELSE text END AS cut, len(regexp_extract_all(text, '[.!?]+')) >= 3 AS enough",
         cut=lambda: F.when(F.col("text").rlike("[.!?]"), F.regexp_extract("text", r"(?s)^.*[.!?]", 0)).otherwise(F.col("text")), enough=lambda: F.regexp_count("text", F.lit("[.!?]+")) >= 3)
_B = r"[ \t\n\x0B\f\r]"
_measure("t66_prose_of_latex", rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%[^\n]*', ' ', 'g'), '\\[a-zA-Z]+\*?(\[[^\]]*\])?', ' ', 'g'), '[{{}}$\\]', ' ', 'g'), '\[[0-9]+\](,{_B}*\[[0-9]+\])*', ' ', 'g'),
  '\bFig\.{_B}*[0-9]+|\bTABLE{_B}+[IVX]+|\bSection~?[IVX]+', ' ', 'g'), '{_B}+', ' ', 'g'), E' \t\n\r\x0B\x0C') AS prose""", prose=lambda: A.prose_of_latex(F.col("text")))
def _matches(kind, pattern, risk):
    """Every match with its offsets: what stands between matches, and the matches, add up to them."""
    p = pattern.replace("'", "''")
    parts = f"(SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS b FROM documents WHERE regexp_matches(text, '{p}'))"
    return f"""SELECT doc_id, '{kind}' AS kind, m[i] AS value, (list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start, '{risk}' AS risk FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {parts})"""


_SECRETS = "found AS (SELECT *, (start + length(value))::INT AS \"end\" FROM (" + " UNION ALL ".join(_matches(kind, p, risk) for kind, patterns in A.SECRETS.items() for p, risk in patterns) + ") WHERE length(value) >= 8 OR kind = 'ssn')"


@query("t42_partly_redacted", f"""WITH {_SECRETS}, o AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found),
g AS (SELECT *, sum((before IS NULL OR start >= before)::INT) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, kind ROWS UNBOUNDED PRECEDING) AS run FROM o),
r AS (SELECT doc_id, run, min(start) AS a, max("end") AS b, arg_min(kind, (start, -"end", kind)) AS kind FROM g GROUP BY doc_id, run),
p AS (SELECT r.doc_id, run, a, b, kind, text, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY run), 0) AS begin_, lead(run) OVER (PARTITION BY r.doc_id ORDER BY run) IS NULL AS last FROM r JOIN documents d ON d.doc_id = r.doc_id),
s AS (SELECT doc_id, string_agg(substr(text, begin_ + 1, a - begin_) || CASE WHEN b - a > 8 THEN substr(text, a + 1, 4) || '...' || substr(text, b - 3, 4) || '[REDACTED]' ELSE '[REDACTED_' || upper(kind) || ']' END || CASE WHEN last THEN substr(text, b + 1) ELSE '' END, '' ORDER BY run) AS redacted FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.redacted, d.text) AS redacted FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id""")
def t42(spark, sf_dir):
    """All ten types, as in t41; matches that overlap are redacted as one."""
    ship(spark)
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", A.partly_shown(F.col("text")).alias("redacted"))


@query("t41_secret_scan", f'WITH {_SECRETS} SELECT doc_id, kind, value, start, "end", risk FROM found')
def t41(spark, sf_dir):
    """Every match of the ten types with its offsets and risk."""
    ship(spark)
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.inline(A.secrets(F.col("text"))))


@query("t44_input_check", f"""WITH {_SECRETS}, c AS (SELECT DISTINCT doc_id FROM found WHERE risk = 'critical')
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'low' ELSE 'critical' END AS risk, c.doc_id IS NULL AS safe FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def t44(spark, sf_dir):
    """Critical secrets of any type make an input unsafe, others leave its risk low."""
    ship(spark)
    critical = F.exists(A.secrets(F.col("text")), lambda x: x["risk"] == "critical")
    return spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", critical.alias("c")).select("doc_id", F.when(F.col("c"), "critical").otherwise("low").alias("risk"), (~F.col("c")).alias("safe"))


# --- passages and tokens
_STOP_SQL = " ".join(f"WHEN contains(part, {w}) THEN begin_ + length(part) - instr(reverse(part), reverse({w})) + 1" for w in ("'. '", "'! '", "'? '", "chr(10) || chr(10)", "chr(10)"))


@query("t4_passage_windows", f"""WITH RECURSIVE w AS (SELECT doc_id, 0::BIGINT AS begin_, 0::BIGINT AS stop, 0 AS k FROM documents WHERE length(text) > 0
UNION ALL SELECT doc_id, begin_, stop, k FROM (SELECT doc_id, begin_, CASE WHEN begin_ + 512 >= n THEN n {_STOP_SQL} ELSE begin_ + 512 END AS stop, k FROM
  (SELECT w.doc_id, length(d.text) AS n, w.k + 1 AS k, CASE WHEN w.k = 0 THEN 0 ELSE greatest(w.begin_ + 1, w.stop - 50) END AS begin_, substr(d.text, CASE WHEN w.k = 0 THEN 0 ELSE greatest(w.begin_ + 1, w.stop - 50) END + 1, 512) AS part FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE w.k = 0 OR w.stop < length(d.text)))),
p AS (SELECT w.doc_id, w.k, trim(substr(d.text, begin_ + 1, stop - begin_), E' \t\n\r\x0B\x0C') AS passage FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE w.k > 0)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS place, passage FROM p WHERE passage <> ''""")
def t4(spark, sf_dir):
    ship(spark)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(A.passage_windows()("text")).alias("place", "passage"))


@query("t5_token_windows", f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 256) / 206))::BIGINT + 1)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, i::INT AS place, array_to_string(w[i * 206 + 1 : i * 206 + 256], ' ') AS passage FROM s""")
def t5(spark, sf_dir):
    runs = _docs(spark, sf_dir).select("doc_id", F.posexplode(A.token_windows(X.words(F.col("text")))).alias("place", "tokens"))
    return runs.select("doc_id", "place", F.array_join("tokens", " ").alias("passage"))


_measure("t6_token_limit", f"len({_W})::INT AS tokens, len({_W}) <= 512 AS fits", tokens=lambda: F.size(X.words(F.col("text"))), fits=lambda: F.size(X.words(F.col("text"))) <= 512)

# --- citations
both("t48_citations", """WITH s AS (SELECT l_orderkey, l_partkey, l_linenumber, 1 - 6 * l_discount AS confidence FROM {lineitem} WHERE 1 - 6 * l_discount >= 0.5),
f AS (SELECT l_orderkey, l_partkey, l_linenumber, confidence, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, confidence) AS copy FROM s),
c AS (SELECT l_orderkey, l_partkey, l_linenumber, confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM f WHERE copy = 1)
SELECT l_orderkey, l_partkey, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(confidence, 6) DESC, k) AS place FROM c WHERE k <= 5""")
_TYPE = """CASE WHEN lower(url) LIKE '%.py%' OR lower(url) LIKE '%.js%' OR lower(url) LIKE '%.ts%' OR lower(url) LIKE '%.java%' OR lower(url) LIKE '%.cpp%' THEN 'code'
WHEN lower(url) LIKE '%.pdf%' OR lower(url) LIKE '%.docx%' OR lower(url) LIKE '%.txt%' THEN 'document' WHEN lower(url) LIKE '%curriculum%' THEN 'curriculum' WHEN lower(url) LIKE '%http%' THEN 'web' ELSE 'document' END"""
_FILE = "CASE WHEN page_id % 5 > 0 THEN concat('file', page_id, '.pdf') END"
_PLACE = "CASE page_id % 4 WHEN 0 THEN concat('page ', page_id) WHEN 1 THEN concat('line ', page_id) WHEN 2 THEN concat('section ', page_id % 9 + 1) END"
both("t49_source_type", f"SELECT page_id, {_TYPE} AS kind, nullif(concat_ws(' — ', {_FILE}, {_PLACE}), '') AS location FROM {{pages}}")
both("t50_source_summary", f"SELECT kind, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, {_TYPE} AS kind FROM {{pages}}) p GROUP BY kind")

# --- arithmetic
@query("m7_expression", "SELECT l_orderkey, l_linenumber, (l_quantity * l_linenumber - 1) / 4 AS x FROM lineitem")
def m7(spark, sf_dir):
    """Expressions given as text; each different one is parsed once and joined back."""
    ship(spark)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("(%d * %d - 1) / 4", F.col("l_quantity").cast("int"), "l_linenumber").alias("e"))
    values = materialize(rows.select("e").distinct().select("e", A.calculated(F.col("e")).alias("x")), "values")
    return rows.join(sized(values), "e").select("l_orderkey", "l_linenumber", "x")


@query("m8_arithmetic", "SELECT p_partkey, '**What is ' || p_partkey || ' plus ' || p_size || '?** = **' || (p_partkey + p_size) || '**' AS answer FROM part")
def m8(spark, sf_dir):
    """Questions of two numbers are answered by expressions, others by a parser."""
    ship(spark)
    asked = table(spark, sf_dir, "part").select("p_partkey", F.format_string("What is %d plus %d?", "p_partkey", "p_size").alias("q"))
    plain, simple = A.two_number_answer(F.col("q")), F.col("q").rlike(A.TWO_NUMBERS)
    return asked.where(simple).select("p_partkey", plain.alias("answer")).unionByName(asked.where(~simple).select("p_partkey", A.arithmetic_answer(F.col("q")).alias("answer")))


@query("m12_merged", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'english' END, lang) AS lang, source FROM documents")
def m12(spark, sf_dir):
    """Metadata of a document with overrides, which win."""
    base = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    over = F.map_filter(F.create_map(F.lit("lang"), F.when(F.col("lang") == "en", "english")), lambda k, v: v.isNotNull())
    merged = F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))
    return _docs(spark, sf_dir).select("doc_id", merged["lang"].alias("lang"), merged["source"].alias("source"))


# --- filters, routing, limits, caches
@query("f12_useful_similarity", f"SELECT qid, vec_id FROM (SELECT vec_id, {_VEC} AS v FROM embeddings), (SELECT vec_id AS qid, {_VEC} AS q FROM embeddings WHERE vec_id % 100 = 0) WHERE {_COS_Q} >= 0.35")
def f12(spark, sf_dir):
    """The hits of each query that are useful."""
    e = _embeddings(spark, sf_dir)
    return V.similar(_asked(e), e, 0.35).select("qid", "vec_id")


both("f18_model_route", """WITH pref AS (SELECT * FROM (VALUES ('low', 'Brand#1', 0), ('low', 'Brand#2', 1), ('medium', 'Brand#2', 0), ('medium', 'Brand#3', 1), ('high', 'Brand#3', 0), ('high', 'Brand#2', 1)) AS v(complexity, tier, place)),
c AS (SELECT t.complexity, p.p_type, p.p_partkey, row_number() OVER (PARTITION BY t.complexity, p.p_type ORDER BY coalesce(f.place, 2), p.p_partkey) AS k
  FROM {part} p CROSS JOIN (SELECT DISTINCT complexity FROM pref) t LEFT JOIN pref f ON f.complexity = t.complexity AND f.tier = p.p_brand WHERE p.p_size <= 20)
SELECT complexity, p_type, p_partkey FROM c WHERE k = 1""")
both("st5_two_limits", """WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS h FROM {events})
SELECT event_id, m <= 1 AND h <= 2 AS allowed FROM n""")
both("st23_compressed", """WITH s AS (SELECT conv_id, turn, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, count(*) OVER (PARTITION BY conv_id) AS n FROM {conversations}),
c AS (SELECT conv_id, max(n) AS n, count_if(used > 100) AS older FROM s GROUP BY conv_id)
SELECT conv_id, n, CASE WHEN n >= 4 AND older >= 2 THEN older ELSE 0 END AS summarised FROM c""")
both("s15_cache_hits", """WITH cached AS (SELECT DISTINCT md5(d.text) AS k FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id)
SELECT d.doc_id, c.k IS NOT NULL AS hit FROM {documents} d LEFT JOIN cached c ON md5(d.text) = c.k""")
both("st14_pending", "SELECT d.doc_id, d.source FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
both("g6_threads", """WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM {conversations} WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM t JOIN {conversations} c ON c.conv_id = t.conv_id AND c.turn > 0 AND floor((c.turn - 1) / 2) = t.turn)
SELECT conv_id, turn, depth FROM t""")

#: Positions of a member in the filter, and bits a member: a false hit for one in a hundred others.
BLOOM_HASHES, BLOOM_BITS = 7, 9.585
_POSITIONS = "list_transform(range(7), lambda i: (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT + i * ('0x' || substr(md5(doc_id::VARCHAR), 9, 8))::BIGINT) % bits)"


@query("a36_bloom", f"""WITH size AS (SELECT ceil(count(DISTINCT doc_id) * 9.585)::BIGINT AS bits FROM labels), bit AS (SELECT DISTINCT unnest({_POSITIONS}) AS p FROM labels, size),
asked AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest({_POSITIONS}) AS p FROM documents, size))
SELECT doc_id, count(*) = count(bit.p) AS member FROM asked LEFT JOIN bit USING (p) GROUP BY doc_id""")
def a36(spark, sf_dir):
    """A Bloom filter of the labelled documents as a table of its set bits, probed for all documents by an equi-join."""
    members = table(spark, sf_dir, "labels")
    bits = int(-(-members.select(F.countDistinct("doc_id")).first()[0] * BLOOM_BITS // 1)) or 1
    part = lambda at: F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), at, 8), 16, 10).cast("long")
    positions = F.explode(F.array(*[(part(1) + i * part(9)) % bits for i in range(BLOOM_HASHES)]))
    held = members.where("doc_id is not null").select(positions.alias("p")).distinct().withColumn("set", F.lit(1))
    asked = _docs(spark, sf_dir).select("doc_id", positions.alias("p")).distinct()
    return asked.join(held, "p", "left").groupBy("doc_id").agg((F.count("*") == F.count("set")).alias("member"))


# --- vectors
@query("v2_cosine_matrix", f"""WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS q FROM e WHERE vec_id % 100 = 0)
SELECT qid, vec_id, round(list_dot_product(v, q) / (greatest(1e-8, sqrt(list_dot_product(v, v))) * greatest(1e-8, sqrt(list_dot_product(q, q)))), 6) + 0.0 AS score FROM e, q""")
def v2(spark, sf_dir):
    """A stated set of queries (ids divisible by 100) against all rows; norms of at least 1e-8."""
    e = _embeddings(spark, sf_dir)
    return V.scores(_asked(e), e).select("qid", "vec_id", (F.round("score", 6) + 0.0).alias("score"))


@query("j11_matched_pairs", f"""WITH x AS (SELECT vec_id, label, unnest({_VEC}) AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) GROUP BY label),
p AS (SELECT e.vec_id, e.label = c.label AS matched, {_COS.format(a="e.v", b="c.c")} AS s FROM (SELECT vec_id, label, {_VEC} AS v FROM embeddings) e, c)
SELECT matched, count(*) AS n, round(avg(s), 5) AS mean FROM p GROUP BY matched""")
def j11(spark, sf_dir):
    """All rows against the centroids of the labels: a row and its own label's match."""
    e = _embeddings(spark, sf_dir)
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centroids = means.groupBy(F.col("label").alias("other")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    scored = V.scores(materialize(centroids, "centroids"), e, query_id="other", query_vec="c", group="label")
    return scored.groupBy((F.col("label") == F.col("other")).alias("matched")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean"))


@query("j12_precision", f"SELECT vec_id, round({_COS.format(a='v', b='r')}, 5) AS fidelity FROM (SELECT vec_id, {_VEC} AS v, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS r FROM embeddings)")
def j12(spark, sf_dir):
    """The same vector in two precisions, by id."""
    e = _embeddings(spark, sf_dir)
    rounded = e.select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("r"))
    return e.join(rounded, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("r")), 5).alias("fidelity"))



@query("k6_wide_candidates", _topk_sql("DESC", _COS_Q, 30))
def k6(spark, sf_dir):
    """Three times ten candidates, for a second step that keeps ten."""
    e = _embeddings(spark, sf_dir)
    return V.nearest(_asked(e), e, 30).withColumn("score", F.round("score", 6))


@query("k5_reranked", f"""WITH c AS ({_topk_sql("DESC", _COS_Q, 30)}),
s AS (SELECT c.qid, c.vec_id, c.rank, round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) AS score FROM c JOIN (SELECT doc_id, {_set("text")} AS w FROM documents) a ON a.doc_id = c.qid JOIN (SELECT doc_id, {_set("text")} AS w FROM documents) b ON b.doc_id = c.vec_id)
SELECT qid, vec_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM s) WHERE place <= 10""")
def k5(spark, sf_dir):
    """Thirty nearest rows of each query, ordered anew by the overlap of words, ten kept."""
    e = _embeddings(spark, sf_dir)
    found = V.nearest(_asked(e), e, 30).select("qid", "vec_id", "rank")
    texts = _docs(spark, sf_dir).select("doc_id", "text")
    both_ = found.join(texts.select(F.col("doc_id").alias("qid"), F.col("text").alias("a")), "qid").join(texts.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("b")), "vec_id")
    scored = both_.select("qid", "vec_id", "rank", F.round(X.jaccard(A.word_set(F.col("a")), A.word_set(F.col("b"))), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank"))
    return scored.withColumn("place", place).where("place <= 10").select("qid", "vec_id", "score", "place")


@query("k5_rerank_or_keep", f"""WITH c AS ({_topk_sql("DESC", _COS_Q, 30)}),
s AS (SELECT c.qid, c.vec_id, c.rank, CASE WHEN b.lang <> 'de' THEN round(len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))), 6) END AS score FROM c JOIN (SELECT doc_id, {_set("text")} AS w FROM documents) a ON a.doc_id = c.qid JOIN (SELECT doc_id, lang, {_set("text")} AS w FROM documents) b ON b.doc_id = c.vec_id),
f AS (SELECT qid, vec_id, rank, CASE WHEN count(*) FILTER (score IS NULL) OVER (PARTITION BY qid) > 0 THEN 0.5::DOUBLE ELSE score END AS score FROM s)
SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank)::INT AS place FROM f QUALIFY place <= 10""")
def k5_keep(spark, sf_dir):
    """The same with a scorer that fails on German texts: a query with one of these keeps the order it had, with 0.5 for each."""
    e = _embeddings(spark, sf_dir)
    found = V.nearest(_asked(e), e, 30).select("qid", "vec_id", "rank")
    texts = _docs(spark, sf_dir).select("doc_id", "lang", "text")
    pairs = found.join(texts.select(F.col("doc_id").alias("qid"), F.col("text").alias("a")), "qid").join(texts.select(F.col("doc_id").alias("vec_id"), "lang", F.col("text").alias("b")), "vec_id")
    overlap = F.round(X.jaccard(A.word_set(F.col("a")), A.word_set(F.col("b"))), 6)
    return reranked(pairs, "qid", "rank", F.when(F.col("lang") != "de", overlap), 10).select("qid", "vec_id", "score", "place")


@query("k16_scoped_search", f"""WITH e AS (SELECT vec_id, label, {_VEC} AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, {_COS.format(a="e.v", b="q.v")} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a="e.v", b="q.v")} DESC, e.vec_id) AS k FROM e JOIN e q ON q.vec_id % 100 = 0 AND q.label = e.label)
SELECT qid, round(avg(s), 6) AS mean FROM s WHERE k <= 3 GROUP BY qid""")
def k16(spark, sf_dir):
    """The three nearest rows of a query's own label, and their mean score."""
    e = _embeddings(spark, sf_dir)
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return V.nearest(asked, e, 3, group="label", own=True).groupBy("qid").agg(F.round(F.avg("score"), 6).alias("mean"))


# --- hashed vectors of texts
_BUCKET = "('0x' || substr(md5(w), 1, 2))::INT % 64"
_SPARSE = f"(SELECT doc_id, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({_words('{t}')}) AS w FROM documents) GROUP BY ALL)"


def _sparse(spark, sf_dir, text):
    """(doc_id, bucket, n): words of a text by 64 buckets of their hash, a stand-in for a model's vector."""
    w = _docs(spark, sf_dir).select("doc_id", F.explode(X.words(F.lower(text))).alias("w"))
    return w.groupBy("doc_id", (F.conv(F.substring(F.md5("w"), 1, 2), 16, 10).cast("int") % 64).alias("bucket")).agg(F.count("*").alias("n"))


@query("x3_hashed_vector", _SPARSE.format(t="text").strip("()"))
def x3(spark, sf_dir):
    return _sparse(spark, sf_dir, F.col("text"))


def _hashed_cosine(name, sql_text, text):
    """Cosine of a document's and the next one's hashed vectors; 0 if either has no words."""

    @query(name, f"""WITH s AS {_SPARSE.format(t=sql_text)}, n AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE) AS norm FROM s GROUP BY doc_id), d AS (SELECT a.doc_id, sum(a.n * b.n)::DOUBLE AS dot FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND a.bucket = b.bucket GROUP BY a.doc_id)
SELECT p.doc_id, round(coalesce(d.dot / (x.norm * y.norm), 0), 6) AS score FROM (SELECT a.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) p LEFT JOIN n x ON x.doc_id = p.doc_id LEFT JOIN n y ON y.doc_id = p.doc_id + 1 LEFT JOIN d ON d.doc_id = p.doc_id""")
    def run(spark, sf_dir):
        s = materialize(_sparse(spark, sf_dir, text()), "hashed")
        norms = s.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
        dots = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), "bucket", F.col("n").alias("m")), ["doc_id", "bucket"]).groupBy("doc_id").agg(F.sum(F.col("n") * F.col("m")).cast("double").alias("dot"))
        ids = _docs(spark, sf_dir).select("doc_id")
        pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
        out = pairs.join(norms, "doc_id", "left").join(norms.select((F.col("doc_id") - 1).alias("doc_id"), F.col("norm").alias("other")), "doc_id", "left").join(dots, "doc_id", "left")
        return out.select("doc_id", F.round(F.coalesce(F.col("dot") / (F.col("norm") * F.col("other")), F.lit(0.0)), 6).alias("score"))


_hashed_cosine("v15_grounding", "left(text, 4000)", lambda: F.left(F.col("text"), F.lit(4000)))
_hashed_cosine("v18_text_similarity", "text", lambda: F.col("text"))


# --- tables written and read again
@query("s4_catalog_round_trip", "SELECT p_name || p_partkey AS code, p_type AS title, p_size AS grade, p_brand AS medium FROM part")
def s4(spark, sf_dir):
    books = table(spark, sf_dir, "part").select(F.concat("p_name", "p_partkey").alias("code"), F.col("p_type").alias("title"), F.col("p_size").alias("grade"), F.col("p_brand").alias("medium"))
    path = fresh_path(spark, "catalog")
    corpus.write_catalog(books, path)
    return corpus.read_catalog(spark, path)


@query("s11_standards_round_trip", "SELECT (item_id % 12 + 1)::INT AS grade_level, 'subject ' || item_id AS subject, text AS topic, len(string_split(text, '.'))::INT AS objectives FROM benchmark")
def s11(spark, sf_dir):
    """Standards stored as a table of typed rows by grade, and read by their schema."""
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 12 + 1).cast("int").alias("grade_level"), F.concat(F.lit("subject "), F.col("item_id").cast("string")).alias("subject"), F.col("text").alias("topic"), F.split("text", r"\.").alias("learning_objectives"), F.split("text", " ").alias("keywords"))
    path = fresh_path(spark, "standards")
    corpus.store_standards(rows, path)
    return corpus.stored_standards(spark, path).select("grade_level", "subject", "topic", F.size("learning_objectives").alias("objectives"))


@query("s13_store", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def s13(spark, sf_dir):
    """Content and chunks written as tables by source; the content read again."""
    content, _ = corpus.store_documents(_docs(spark, sf_dir), fresh_path(spark, "store"))
    return spark.read.parquet(content).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s13_committed_store", r"""WITH c AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS chunk FROM documents), k AS (SELECT doc_id, source, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM c WHERE length(trim(chunk)) >= 120 GROUP BY ALL)
SELECT source, count(*) AS documents, sum(chunks)::BIGINT AS chunks, sum(chunks)::BIGINT AS vectors, sum(chars)::BIGINT AS chars FROM k GROUP BY source""")
def s13_committed(spark, sf_dir):
    """Content, chunks of at least 120 characters and their vectors in a store of three tables, committed in two parts; documents without a chunk aren't stored. What a failed third part wrote isn't seen."""
    store = Store(spark, fresh_path(spark, "committed"))
    docs = spread(_docs(spark, sf_dir).select("doc_id", "source", "text"))
    chunks = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("place", "chunk")).where(F.length(F.trim("chunk")) >= 120)
    vectors = chunks.select("doc_id", "place", F.array(F.length("chunk").cast("double"), F.size(X.words(F.col("chunk"))).cast("double")).alias("vector"))
    for half in (0, 1):
        part = F.col("doc_id") % 2 == half
        store.commit(content=chunks.where(part).select("doc_id", "source").distinct(), chunks=chunks.where(part), vectors=vectors.where(part))
    # a part that breaks off: its content is written, its manifest is not
    docs.select("doc_id", "source").write.parquet(f"{store.path}/content/broken")
    counted = store.read("chunks").join(store.read("vectors"), ["doc_id", "place"]).groupBy("source").agg(F.count("*").alias("chunks"), F.count("vector").alias("vectors"), F.sum(F.length("chunk")).alias("chars"))
    return store.read("content").groupBy("source").agg(F.count("*").alias("documents")).join(counted, "source").select("source", "documents", "chunks", "vectors", "chars")


@query("s28_delete_everywhere", r"""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk FROM documents), gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT d.doc_id, count(c.doc_id) AS chunks FROM documents d LEFT JOIN (SELECT doc_id FROM c WHERE length(trim(chunk)) >= 120) c USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL) GROUP BY d.doc_id""")
def s28_everywhere(spark, sf_dir):
    """Toxic documents go from a store's content and chunks in one commit."""
    store = Store(spark, fresh_path(spark, "committed"))
    docs = spread(_docs(spark, sf_dir).select("doc_id", "source", "text"))
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "chunk")).where(F.length(F.trim("chunk")) >= 120)
    store.commit(content=docs.select("doc_id", "source"), chunks=chunks)
    store.delete(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "content", "chunks")
    left = store.read("chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return store.read("content").join(left, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


_measure("s18_markdown", "'# ' || source || chr(10) || chr(10) || text || chr(10) AS value", value=lambda: F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n")))
