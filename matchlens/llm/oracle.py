"""SQL equivalents of the queries that SQL can express, independent of the operators."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {}

# Every line's tokens, votes per leaf and position, templates, and the occurrences that go.
ORACLE_SQL["op2_line_templates"] = rf"""
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM texts),
words AS (SELECT doc_id, text, line, regexp_extract_all(string_split(text, chr(10))[line], '{WORDS}') AS own FROM raw),
split AS (SELECT *, len(own) AS size, [CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END FOR x IN own] AS tokens FROM words WHERE len(own) > 0),
lines AS (SELECT doc_id, text, line, size, tokens, size || chr(0) || array_to_string(tokens[1:3], chr(0)) AS leaf,
                 array_to_string(CASE WHEN 2 * len([x FOR x IN tokens IF x = '<*>']) > size THEN own ELSE tokens END, chr(0)) AS body FROM split),
bodies AS (SELECT leaf, body, size, count(DISTINCT text) AS docs, any_value(tokens) AS tokens FROM lines GROUP BY leaf, body, size),
leaves AS (SELECT leaf, sum(docs) AS in_leaf FROM bodies WHERE size >= 3 GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 3 AND min(docs) < 3),
each AS (SELECT leaf, in_leaf, body, docs, place, tokens[place] AS token FROM (
           SELECT b.*, in_leaf, unnest(range(1, len(b.tokens) + 1)) AS place FROM bodies b JOIN leaves USING (leaf))),
fixed AS (SELECT leaf, place, token FROM each WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(docs) >= 3 AND sum(docs) >= 0.25 * any_value(in_leaf)),
found AS (SELECT leaf, body, count(*) FILTER (place > 3) AS n, string_agg(place || chr(1) || token, chr(0) ORDER BY place) AS template
          FROM each JOIN fixed USING (leaf, place, token) GROUP BY leaf, body),
named AS (SELECT l.doc_id, l.text, l.line, l.size, l.leaf, l.body,
                 CASE WHEN f.n >= (l.size - 3) * 0.5 AND f.n > 0 THEN 'T' || f.template ELSE 'B' || l.body END AS template
          FROM lines l LEFT JOIN found f ON f.leaf = l.leaf AND f.body = l.body),
spread AS (SELECT leaf, template FROM named GROUP BY leaf, template, size HAVING count(DISTINCT text) >= CASE WHEN size < 3 THEN 5 ELSE 3 END),
long AS (SELECT leaf, body FROM lines WHERE size > 50 GROUP BY leaf, body HAVING count(DISTINCT text) >= 2),
hit AS (SELECT n.doc_id, n.text, n.line, row_number() OVER (PARTITION BY n.leaf, n.template ORDER BY n.doc_id NULLS FIRST, n.line) AS nth
        FROM named n JOIN spread s ON s.leaf = n.leaf AND s.template = n.template
        UNION ALL SELECT n.doc_id, n.text, n.line, row_number() OVER (PARTITION BY n.leaf, n.body ORDER BY n.doc_id NULLS FIRST, n.line)
        FROM lines n JOIN long s ON s.leaf = n.leaf AND s.body = n.body),
gone AS (SELECT doc_id, text, list(DISTINCT line) AS drops FROM hit WHERE nth > 1 GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN g.drops IS NULL THEN d.text ELSE array_to_string([string_split(d.text, chr(10))[i]
         FOR i IN range(1, len(string_split(d.text, chr(10))) + 1) IF NOT list_contains(g.drops, i)], chr(10)) END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(len(g.drops), 0) AS n_dropped
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.text = d.text"""

# All pairs that share a shingle, and the components of those that are similar.
ORACLE_SQL["op4_partenum_join"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{WORDS}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
               SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN smallest m ON m.doc_id = d.doc_id"""

# The same for pairs of words; equal sets meet the others once.
ORACLE_SQL["op12_setsketch"] = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{WORDS}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (
               SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, chr(0) ORDER BY s)) AS h FROM shingles GROUP BY doc_id),
firsts AS (SELECT h, min(doc_id) AS doc_id FROM sets GROUP BY h),
own AS (SELECT s.doc_id, s.s FROM shingles s JOIN firsts f ON f.doc_id = s.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM own a JOIN own b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
smallest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
found AS (SELECT t.doc_id, coalesce(m.component_id, f.doc_id) AS component_id FROM sets t JOIN firsts f ON f.h = t.h LEFT JOIN smallest m ON m.doc_id = f.doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN found c ON c.doc_id = d.doc_id"""

BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {k + 1}, 5) AS BIGINT) // {1 << shift}) % 32 + 1 AS BIGINT), 1)"
    for k in range(0, 40, 5) for shift in (15, 10, 5, 0))

ORACLE_SQL["op8_warc_transactions"] = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM f"""

# CRC-32 byte by byte with its table of 256 numbers; pairs of near words by what is left without one letter.
ORACLE_SQL["op11_fm_variants"] = rf"""
WITH RECURSIVE steps AS (SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, {LOWER.format("run")} AS run, count(*) AS m
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (SELECT r.*, t, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(concat(doc_id, ':', run))), '..')] AS b FROM runs r, crc),
hashed AS (SELECT run, m, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes),
kept AS (SELECT m, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(m)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
          FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word"""
