"""Full text search, longest prefixes, and iterative retrieval over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gyre.functions import answers as A
from gyre.functions import text as X
from gyre.functions.english import BEFORE, LONG_STARTS, STEP_2, STEP_3, STEP_4, STOP_WORDS, UNTOUCHED, WHOLE
from gyre.functions.responses import first_object
from gyre.operators.dialogue import FULL, RECENT, context_sizes
from gyre.operators.fulltext import full_text_search, inverted_index
from gyre.operators.loops import iterative_retrieval, word_retriever
from gyre.operators.prefixes import longest_prefixes
from gyre.plans.registry import query
from gyre.plans.text import _W
from gyre.session import materialize, spread, table


def _ends(endings: dict[str, str], region: str) -> str:
    """A step of the stemmer in SQL: w is the word so far, r1 and r2 the lengths before the regions."""
    cases = []
    for e, to in sorted(endings.items(), key=lambda x: -len(x[0])):
        start = "r2" if e == "ative" else region
        stem = f"left(w, length(w) - {len(e)})"
        before = f" AND regexp_matches({stem}, '{BEFORE[e]}')" if e in BEFORE else ""
        cases.append(f"WHEN ends_with(w, '{e}') THEN CASE WHEN length(w) - {len(e)} >= {start}{before} THEN {stem} || '{to}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


_SHORT_END = "regexp_matches({}, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$')"
_REST = "length(regexp_extract({}, '[aeiouy][^aeiouy](.*)$', 1))"
_FOUND = "regexp_matches({}, '[aeiouy][^aeiouy]')"
_CUT = "left(w, length(w) - length(regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$')))"
#: (word, lexeme) of the distinct words of CTE `word`, by the rules of the same definition in SQL.
STEMS = rf"""
s0 AS (SELECT word, regexp_replace(regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g'), '([aeiouy])y', '\1Y', 'g') AS w FROM word),
s1 AS (SELECT word, w, CASE WHEN regexp_matches(w, '^({LONG_STARTS})') THEN length(regexp_extract(w, '^({LONG_STARTS})')) WHEN {_FOUND.format("w")} THEN length(w) - {_REST.format("w")} ELSE length(w) END AS r1 FROM s0),
s2 AS (SELECT *, CASE WHEN {_FOUND.format("substr(w, r1 + 1)")} THEN length(w) - {_REST.format("substr(w, r1 + 1)")} ELSE length(w) END AS r2 FROM s1),
s3 AS (SELECT word, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN ends_with(w, 's') AND NOT ends_with(w, 'us') AND NOT ends_with(w, 'ss') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w FROM s2),
s4 AS (SELECT *, w AS plural, regexp_extract(w, '(eedly|eed|ingly|edly|ing|ed)$') AS e FROM s3),
s5 AS (SELECT word, r1, r2, plural, e, CASE WHEN starts_with(e, 'ee') THEN CASE WHEN length({_CUT}) >= r1 THEN {_CUT} || 'ee' ELSE w END WHEN e <> '' AND regexp_matches({_CUT}, '[aeiouy]') THEN {_CUT} ELSE w END AS w FROM s4),
s6 AS (SELECT word, r1, r2, plural, CASE WHEN starts_with(e, 'ee') OR w = plural THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) WHEN length(w) <= r1 AND {_SHORT_END.format("w")} THEN w || 'e' ELSE w END AS w FROM s5),
s7 AS (SELECT word, r1, r2, plural, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s6),
s8 AS (SELECT word, r1, r2, plural, {_ends(STEP_2, "r1")} AS w FROM s7),
s9 AS (SELECT word, r1, r2, plural, {_ends(STEP_3, "r1")} AS w FROM s8),
s10 AS (SELECT word, r1, r2, plural, {_ends(STEP_4, "r2")} AS w FROM s9),
s11 AS (SELECT word, plural, lower(CASE WHEN ends_with(w, 'e') AND (length(w) > r2 OR (length(w) > r1 AND NOT {_SHORT_END.format("left(w, length(w) - 1)")})) THEN left(w, length(w) - 1) WHEN ends_with(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END) AS w FROM s10),
stem AS (SELECT word, CASE {" ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in WHOLE.items())} WHEN length(word) <= 2 THEN word WHEN plural IN ({", ".join(f"'{x}'" for x in sorted(UNTOUCHED))}) THEN plural ELSE w END AS lexeme FROM s11 WHERE word NOT IN ({", ".join(f"'{x}'" for x in sorted(STOP_WORDS))}))"""

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("t58_full_text", rf"""WITH dt AS (SELECT doc_id, unnest({_TOKENS}) AS word, unnest(range(1, len({_TOKENS}) + 1)) AS p FROM documents),
qt AS (SELECT DISTINCT item_id, n, unnest({_TOKENS}) AS word FROM benchmark, (VALUES (1)) v(n)),
word AS (SELECT word FROM dt UNION SELECT word FROM qt), {STEMS},
q AS (SELECT DISTINCT item_id, lexeme FROM qt JOIN stem USING (word)), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
occ AS (SELECT q.item_id, doc_id, lexeme, p FROM dt JOIN stem USING (word) JOIN q USING (lexeme)),
hit AS (SELECT item_id, doc_id, n FROM occ JOIN n USING (item_id) GROUP BY item_id, doc_id, n HAVING count(DISTINCT lexeme) = n),
own AS (SELECT occ.*, n FROM occ JOIN hit USING (item_id, doc_id)),
pair AS (SELECT a.item_id, a.doc_id, sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp((b.p - a.p) / 1.5::DOUBLE - 2))))) AS s FROM own a JOIN own b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND a.lexeme <> b.lexeme AND b.p > a.p AND b.p - a.p <= 100 GROUP BY ALL),
single AS (SELECT item_id, doc_id, sum(0.1::DOUBLE / (k * k)) / 1.64493406685::DOUBLE AS s FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p) AS k FROM own WHERE n = 1) GROUP BY ALL)
SELECT item_id, doc_id, round(CASE WHEN n = 1 THEN single.s ELSE 1 - exp(coalesce(pair.s, 0)) END, 6) + 0.0 AS score FROM hit LEFT JOIN pair USING (item_id, doc_id) LEFT JOIN single USING (item_id, doc_id)""")
def t58_full_text(spark, sf_dir):
    """Each benchmark item as a question: all documents that have all its lexemes, with their rank."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = full_text_search(inverted_index(docs, "doc_id"), table(spark, sf_dir, "benchmark").select("item_id", "text"), "doc_id", "item_id")
    return found.select("item_id", "doc_id", (F.round("score", 6) + 0.0).alias("score"))


@query("j15_any_length", f"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), s AS (SELECT doc_id, w[1 : (doc_id % 61 + 1)::INT] AS w FROM d WHERE doc_id % 2 = 0 AND len(w) > 0), c AS (SELECT w, min(doc_id) AS entry FROM s GROUP BY w),
p AS (SELECT doc_id, w, unnest(range(1, least(61, len(w)) + 1)) AS n FROM d)
SELECT p.doc_id, max(n)::INT AS size, arg_max(entry, n) AS entry FROM p JOIN c ON c.w = p.w[1 : p.n::INT] GROUP BY p.doc_id""")
def j15_any_length(spark, sf_dir):
    """The first 1 to 61 words of the even documents are stored; every document asks with its whole text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.words(F.col("text")).alias("w"))
    stored = d.where("doc_id % 2 = 0").select("doc_id", F.slice("w", F.lit(1), (F.col("doc_id") % 61 + 1).cast("int")).alias("w"))
    return longest_prefixes(d, stored, "doc_id", "w")


# --- broken responses
def _response(text, key):
    """A model's response with an object in it: behind a word or in a fence, nested, with braces and quotes in its strings; every fifth is cut off."""
    quoted = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    body = F.concat(F.lit('{"reply": "{'), quoted, F.lit('}}\\"", "meta": {"n": '), F.length(text).cast("string"), F.lit(', "tags": ["}", "a"]}}'))
    whole = F.when(key % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone {}."))).when(key % 3 == 1, F.concat(F.lit("Here it is. "), body, F.lit(' And {"more": 1}'))).otherwise(body)
    return F.when(key % 5 == 0, F.left(whole, F.length(whole) - 40)).otherwise(whole)


_SQL_BODY = r"""'{"reply": "{' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '}}\"", "meta": {"n": ' || length(text) || ', "tags": ["}", "a"]}}'"""
_SQL_WHOLE = f"""CASE k % 3 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || ({_SQL_BODY}) || chr(10) || '```' || chr(10) || 'Done {{}}.' WHEN 1 THEN 'Here it is. ' || ({_SQL_BODY}) || ' And {{"more": 1}}' ELSE {_SQL_BODY} END"""


@query("m10_balanced_object", f"""WITH t AS (SELECT conv_id, turn, text, conv_id + turn AS k FROM conversations), w AS (SELECT conv_id, turn, k, text, {_SQL_WHOLE} AS whole FROM t)
SELECT conv_id, turn, CASE WHEN k % 5 = 0 THEN NULL ELSE md5({_SQL_BODY}) END AS digest, CASE WHEN k % 5 = 0 THEN NULL ELSE length(text) END AS n FROM w""")
def m10_balanced(spark, sf_dir):
    """The first whole object of responses around the turns of all conversations, whatever stands about it; none of those cut off."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    found = turns.select("conv_id", "turn", first_object(_response(F.col("text"), F.col("conv_id") + F.col("turn"))).alias("o"))
    return found.select("conv_id", "turn", F.md5("o").alias("digest"), F.get_json_object("o", "$.meta.n").cast("long").alias("n"))


# --- contexts
_MOST = 400
_POINT = """CASE role WHEN 'user' THEN 'User asked: ' || CASE WHEN length(t) > 100 THEN left(t, 100) || '...' ELSE t END WHEN 'assistant' THEN 'Assistant: ' || CASE WHEN contains(t, '.') THEN split_part(t, '.', 1) ELSE left(t, 100) END END"""


def _context_sql() -> str:
    target, full = int(_MOST * RECENT), _MOST * FULL
    recent = f"len(list_filter(range(1, len(h) + 1), lambda i: list_sum(list_transform(list_slice(h, len(h) - i + 1, len(h)), lambda x: x.n)) <= {target}))"
    points = f"list_filter(list_transform(list_slice(h, 1, len(h) - recent), lambda x: x.p), lambda p: p IS NOT NULL)"
    return f"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, length(text) // 4 AS n, trim(text, E' \t\n\r\x0B\x0C') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
e AS (SELECT conv_id, turn, k, {{'n': n, 'p': {_POINT}}} AS x FROM c),
r AS (SELECT conv_id, turn, k, [x] AS h, x.n AS tokens, 0 AS compressed, '' AS summary FROM e WHERE k = 1
UNION ALL SELECT conv_id, turn, k, CASE WHEN due THEN list_slice(h, len(h) - recent + 1, len(h)) ELSE h END, CASE WHEN due THEN coalesce(list_sum(list_transform(list_slice(h, len(h) - recent + 1, len(h)), lambda x: x.n)), 0)::BIGINT + length(said) // 4 ELSE tokens END, compressed + due::INT, CASE WHEN due THEN said ELSE summary END
  FROM (SELECT *, tokens > {full} AND len(h) >= 4 AND len(h) - recent >= 2 AS due, array_to_string(list_slice(points, greatest(1, len(points) - 4), len(points)), ' | ') AS said
    FROM (SELECT *, {points} AS points FROM (SELECT *, {recent} AS recent FROM (SELECT e.conv_id, e.turn, e.k, list_append(r.h, e.x) AS h, r.tokens + e.x.n AS tokens, r.compressed, r.summary FROM r JOIN e ON e.conv_id = r.conv_id AND e.k = r.k + 1)))))
SELECT conv_id, turn, len(h)::INT AS held, tokens::BIGINT AS tokens, compressed::INT AS compressed, md5(summary) AS summary FROM r"""


@query("st23_context_fold", _context_sql())
def st23_fold(spark, sf_dir):
    """What a context of 400 tokens holds after each turn of each conversation, and the summary of what it gave up."""
    found = context_sizes(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), _MOST)
    return found.withColumn("summary", F.md5("summary"))


# --- iterative retrieval
def _round_sql(k: int, template: str) -> str:
    """One round: the best documents by the question's words, their relevance, and which questions are still open."""
    asked = f"SELECT conv_id, turn, text, '{template}' || text AS question FROM asked" if k == 0 else f"SELECT a.conv_id, a.turn, a.text, '{template}' || a.text AS question FROM asked a JOIN done{k - 1} USING (conv_id, turn) WHERE NOT finished"
    return f"""q{k} AS ({asked}), w{k} AS (SELECT DISTINCT conv_id, turn, unnest({_W.replace("(text", "(lower(question)")}) AS w FROM q{k}),
h{k} AS (SELECT conv_id, turn, doc_id, count(*) AS hits FROM w{k} JOIN dw USING (w) GROUP BY ALL), r{k} AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY hits DESC, doc_id) AS rank FROM h{k} QUALIFY rank <= 8),
all{k} AS (SELECT conv_id, turn, doc_id FROM r{k}{f" UNION SELECT conv_id, turn, doc_id FROM all{k - 1}" if k else ""}),
rel{k} AS (SELECT r.conv_id, r.turn, avg(least(1.0::DOUBLE, 2 * coalesce(o.own, 0)::DOUBLE / greatest(1, n.n))) AS relevance FROM r{k} r JOIN own_n n USING (conv_id, turn) LEFT JOIN own_hits o ON o.conv_id = r.conv_id AND o.turn = r.turn AND o.doc_id = r.doc_id WHERE r.rank <= 5 GROUP BY ALL),
done{k} AS (SELECT q.conv_id, q.turn, coalesce(relevance, 0) AS relevance, (SELECT count(*) FROM all{k} a WHERE a.conv_id = q.conv_id AND a.turn = q.turn) AS found, coalesce(relevance, 0) >= 0.6 AND (SELECT count(*) FROM all{k} a WHERE a.conv_id = q.conv_id AND a.turn = q.turn) >= 3 AS finished FROM q{k} q LEFT JOIN rel{k} USING (conv_id, turn))"""


_TEMPLATES = ("", A.REFORMULATIONS[0], A.REFORMULATIONS[1])


@query("st24_iterative_retrieval", f"""WITH dw AS (SELECT DISTINCT doc_id, unnest({_W.replace("(text", "(lower(text)")}) AS w FROM documents), asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id % 100 = 0),
own AS (SELECT DISTINCT conv_id, turn, unnest({_W.replace("(text", "(lower(text)")}) AS w FROM asked), own_n AS (SELECT conv_id, turn, count(w) AS n FROM asked LEFT JOIN own USING (conv_id, turn) GROUP BY ALL), own_hits AS (SELECT conv_id, turn, doc_id, count(*) AS own FROM own JOIN dw USING (w) GROUP BY ALL),
{", ".join(_round_sql(k, t) for k, t in enumerate(_TEMPLATES))},
every AS (SELECT 1 AS rounds, * FROM done0 WHERE finished UNION ALL SELECT 2, * FROM done1 WHERE finished UNION ALL SELECT 3, * FROM done2)
SELECT conv_id, turn, rounds::INT AS rounds, found, round(relevance, 6) + 0.0 AS relevance FROM every""")
def st24(spark, sf_dir):
    """User turns of conversations whose id is divisible by 100 ask documents, three rounds at most; only questions without three results of enough relevance ask again, in other words."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # written once, as every round reads it
    index = materialize(docs.select("doc_id", F.array_distinct(X.words(F.lower("text"))).alias("w")), "text-words")
    asked = table(spark, sf_dir, "conversations").where("role = 'user' AND conv_id % 100 = 0").select("conv_id", "turn", "text")
    found = iterative_retrieval(asked, ["conv_id", "turn"], "text", word_retriever(index, "doc_id", 8), "doc_id", _TEMPLATES, least_results=3, least_relevance=0.6)
    return found.select("conv_id", "turn", "rounds", "found", (F.round("relevance", 6) + 0.0).alias("relevance"))
