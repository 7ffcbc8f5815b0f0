"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# words between ASCII white space
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH RECURSIVE item0 AS (SELECT DISTINCT item_id, {_WORDS.format("lower(text)")} AS w FROM benchmark),
item AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM item0 WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, o, array_to_string(w[o + 1 : o + k], ' ') AS s, n - k + 1 AS m FROM (SELECT item_id, w, n, k, unnest(range(0, n - k + 1)) AS o FROM item)),
txt AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
doc AS (SELECT text, {_WORDS.format("lower(text)")} AS w FROM txt),
dsh AS (SELECT text, w, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s FROM (SELECT text, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM doc, (SELECT DISTINCT k FROM item))),
al AS (SELECT d.text, i.item_id, i.n, i.k, i.m, d.p, greatest(0, least(d.p - i.o, len(d.w) - i.n)) AS start FROM dsh d JOIN ish i ON d.k = i.k AND d.s = i.s),
ok AS (SELECT text, item_id FROM al GROUP BY text, item_id, m HAVING count(DISTINCT p) >= ceil(80 * m / 100)),
win AS (SELECT DISTINCT al.text, al.item_id, al.n, al.k, al.m, al.start FROM al JOIN ok ON al.text = ok.text AND al.item_id IS NOT DISTINCT FROM ok.item_id),
wsh AS (SELECT w.text, w.item_id, w.n, w.start, w.m, d.s, count(*) AS c FROM win w JOIN dsh d ON d.text = w.text AND d.k = w.k AND d.p >= w.start AND d.p < w.start + w.m GROUP BY ALL),
tot AS (SELECT text, item_id, n, start, m, sum(c) AS total FROM wsh GROUP BY ALL),
isc AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
hit AS (SELECT w.text, w.item_id, w.n, w.start, sum(least(w.c, i.c)) AS both FROM wsh w JOIN isc i ON w.item_id IS NOT DISTINCT FROM i.item_id AND w.s = i.s GROUP BY ALL),
sim AS (SELECT t.text, t.item_id, h.both::BIGINT AS b, (t.total + t.m - h.both)::BIGINT AS a FROM tot t JOIN hit h ON t.text = h.text AND t.item_id IS NOT DISTINCT FROM h.item_id AND t.n = h.n AND t.start = h.start),
res AS (SELECT text, item_id, max(b::DOUBLE / a) AS similarity FROM sim WHERE 100 * b >= 80 * a GROUP BY ALL),
agg AS (SELECT text, count(*) AS n_items, max(similarity) AS similarity FROM res GROUP BY text)
SELECT d.doc_id, a.text IS NOT NULL AS contaminated, coalesce(a.n_items, 0) AS n_items, a.similarity FROM documents d LEFT JOIN agg a ON d.text = a.text
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY r),
line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
base AS (SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN rep USING (r) LEFT JOIN line USING (r)),
rule AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
judged AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS rule_failed FROM rule),
host AS (SELECT source, count(*) AS n, count(*) FILTER (rule_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
mom AS (SELECT sum(f * 1000000 // n)::DOUBLE / count(*) AS mu, sum((f * 1000000 // n) * (f * 1000000 // n))::DOUBLE / count(*) AS sq FROM host),
prior AS (SELECT mu / 1e6 AS m, (sq - mu * mu) / 1e12 AS v FROM mom),
weight AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m * (1 - m) / v - 1)) ELSE 1000.0::DOUBLE END AS k FROM prior),
rate AS (SELECT source, (f + m * k) / (n + k) AS rate FROM host, weight)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(rate >= 0.5, false) AND rule_failed) AS kept, rule_failed, coalesce(rate >= 0.5, false) AS host_strict
FROM judged LEFT JOIN rate USING (source)
"""

OP3 = """
WITH own AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
ans AS (SELECT conv_id, turn AS last_turn, coalesce(text, '') AS answer FROM own WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, coalesce(text, '') DESC) = 1),
pair AS (SELECT a.conv_id, a.last_turn, coalesce(n.conv_id, p.conv_id) AS donor, coalesce(n.answer, p.answer) AS answer FROM ans a LEFT JOIN ans n ON n.conv_id = a.conv_id + 1 LEFT JOIN ans p ON p.conv_id = a.conv_id - 1),
sides AS (SELECT conv_id, 'a' AS side, turn, role, text FROM own SEMI JOIN (FROM pair WHERE donor IS NOT NULL) q USING (conv_id)
  UNION ALL SELECT o.conv_id, 'b', o.turn, o.role, o.text FROM own o JOIN pair q ON q.conv_id = o.conv_id AND donor IS NOT NULL AND (o.turn IS NULL OR o.turn < q.last_turn)
  UNION ALL SELECT conv_id, 'b', last_turn, 'assistant', answer FROM pair WHERE donor IS NOT NULL),
t AS (SELECT conv_id, side, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides),
most AS (SELECT conv_id, least(max(k) FILTER (side = 'a'), max(k) FILTER (side = 'b')) AS n FROM t GROUP BY conv_id),
diff AS (SELECT a.conv_id, min(a.k) AS first FROM t a JOIN t b ON a.side = 'a' AND b.side = 'b' AND a.conv_id = b.conv_id AND a.k = b.k WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.conv_id),
cut AS (SELECT conv_id, coalesce(first - 1, n)::INT AS s FROM most LEFT JOIN diff USING (conv_id)),
r AS (SELECT t.*, k <= s AS shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line, 13 + length(role) AS head FROM t JOIN cut USING (conv_id)),
x AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id, side, shared ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + head AS start FROM r),
out AS (SELECT conv_id, side, shared, string_agg(line, '' ORDER BY k) AS lines, string_agg(start || ':' || (start + length(text) + 10), ' ' ORDER BY k) FILTER (role = 'assistant') AS spans FROM x GROUP BY ALL)
SELECT c.conv_id AS chosen_id, p.donor, c.s AS n_shared, coalesce(m.lines, '') AS prompt, coalesce(a.lines, '') AS chosen, coalesce(b.lines, '') AS rejected, coalesce(a.spans, '') AS chosen_spans, coalesce(b.spans, '') AS rejected_spans
FROM cut c JOIN pair p USING (conv_id) LEFT JOIN out m ON m.conv_id = c.conv_id AND m.side = 'a' AND m.shared LEFT JOIN out a ON a.conv_id = c.conv_id AND a.side = 'a' AND NOT a.shared LEFT JOIN out b ON b.conv_id = c.conv_id AND b.side = 'b' AND NOT b.shared
"""

OP4 = """
WITH rule(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
hit AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM b JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b LEFT JOIN hit USING (r)
"""

OP5 = """
WITH a AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
  list_transform(range(40), lambda i: instr('0123456789abcdef', hex[i + 1]) - 1) || [0] AS nib FROM a)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((((nib[(5 * j) // 4 + 1] * 16 + nib[(5 * j) // 4 + 2]) >> (3 - (5 * j) % 4)) & 31) + 1)::BIGINT]), '') AS payload_digest,
  CASE WHEN page_id = first OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, {_WORDS.format("text")} AS w FROM documents),
win AS (SELECT r, id, p, md5(array_to_string(w[p : p + 49], ' ')) AS s FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS p FROM d)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM (SELECT r, id, p, min(id) OVER (PARTITION BY s) AS first FROM win) WHERE first < id),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.q = gone.q GROUP BY word.r),
n AS (SELECT r, count(*) AS c FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS e FROM d),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS e FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * common >= 80 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT reach.v, edge.b FROM reach JOIN edge ON reach.u = edge.a),
comp AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(e)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN comp ON doc_id = v
"""

def _op11() -> str:
    """The cheapest edits turn by turn: for each state of the pattern the least (cost, audit, lines) so far."""

    def add(x: str, cost: str, letter: str, line: str | None) -> str:
        lines = f"{x}.t" if line is None else f"{x}.t || chr(10) || {line}"
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {lines}}} END"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "'user:'", "'assistant:'"
    inserted = "SELECT *, " + least("s2", *[add(x, "2", "I", user) for x in ("s0", "s1", "s3")]) + " AS i2"
    closed = f"SELECT *, {least('s3', add('i2', '2', 'I', assistant))} AS i3"
    on = lambda ok, way: f"CASE WHEN {ok} THEN {way} END"  # noqa: E731
    keep, whole = "NOT faulty AND initial = '{}'", "role || ':' || text"
    gone = [add(x, "3", "D", None) for x in ("s0", "s1", "i2", "i3")]
    n1 = least(gone[1], on(keep.format("s"), add("s0", "cut", "K", whole)))
    n2 = least(gone[2], *[on(keep.format("u"), add(x, "cut", "K", whole)) for x in ("s0", "s1", "i3")], *[on("NOT faulty", add(x, "2 + cut", "R", "'user:' || text")) for x in ("s0", "s1", "i3")])
    n3 = least(gone[3], on(keep.format("a"), add("i2", "cut", "K", whole)), on("NOT faulty", add("i2", "2 + cut", "R", "'assistant:' || text")))
    byte = "list_reduce(list_concat([xor(c, b)], range(8)::UBIGINT[]), lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(name, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: {byte}), 4294967295::UBIGINT)"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
r AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, NOT regexp_matches(text, '[^ 	-]') AS blank, NOT regexp_matches(text, '[.!?][ 	-]*\z') AS open FROM d),
f AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS duplicate, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM r),
t AS (SELECT *, blank OR duplicate AS faulty, CASE WHEN open AND NOT blank AND NOT duplicate THEN 1 ELSE 0 END AS cut FROM f),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM t GROUP BY conv_id),
w AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM stat
  UNION ALL SELECT conv_id, k, {gone[0]}, {n1}, {n2}, {n3} FROM ({closed} FROM ({inserted} FROM (SELECT t.*, s0, s1, s2, s3 FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k + 1)))),
last AS (SELECT conv_id, {least('s0', 'i3')} AS e FROM ({closed} FROM ({inserted} FROM w SEMI JOIN stat ON stat.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = stat.n)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a, e WHERE a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS e FROM d),
x AS (SELECT doc_id, len(e) AS n, unnest(e) AS e FROM s),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.e = b.e AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * common >= 90 * (na + nb - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS v, doc_id AS u FROM s UNION SELECT reach.v, edge.b FROM reach JOIN edge ON reach.u = edge.a),
comp AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT doc_id, len(e)::BIGINT AS n_shingles, component_id FROM s JOIN comp ON doc_id = v
"""

SQL = {
    "op1_decontaminate": OP1, "op2_quality": OP2, "op3_preferences": OP3, "op4_url_filters": OP4, "op5_warc": OP5,
    "op7_substring_dedup": OP7, "op10_near_duplicates": OP10, "op11_conversation_repair": _op11(), "op12_hard_negatives": OP12, "op13_signature_join": OP13,
}  # fmt: skip
