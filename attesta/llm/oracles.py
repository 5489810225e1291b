"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM bs),
sizes AS (SELECT DISTINCT n FROM g),
ds AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, s, ds.n, item FROM ds JOIN g ON g.n = ds.n AND g.gram = array_to_string(w[s:s + ds.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)
"""

TOKEN_COUNTS = rf"""
WITH c AS (SELECT source, lang, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS nth,
  len({_WORDS}) AS words, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS spaces FROM documents),
t AS (SELECT source, lang, nth, 'words-1' AS tokenizer, words AS n FROM c UNION ALL SELECT source, lang, nth, 'spaces-1', spaces FROM c)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens,
  CAST(count(*) FILTER (nth = 1) AS BIGINT) AS unique_docs, CAST(coalesce(sum(n) FILTER (nth = 1), 0) AS BIGINT) AS unique_tokens
FROM t GROUP BY ALL
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, nth, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY ALL),
e AS (SELECT doc_id, nth, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY nth), 0) AS start FROM s),
p AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY nth) AS front FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(concat(coalesce(front, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""

_TERMS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

BALL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
total AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
c AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM c GROUP BY t),
x AS (SELECT r, doc_id, t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT)
  * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nt)))) AS s FROM c JOIN f USING (t), total),
g AS (SELECT item_id, r, doc_id, CAST(sum(s * times) AS BIGINT) AS score FROM q JOIN x USING (t) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""

# A checksum is the exclusive or of one constant for each byte and its distance from the end, and one for the length.
SPELLING = f"""
WITH RECURSIVE base AS (SELECT b, list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b)),
far AS (SELECT 0 AS k, b, v FROM base UNION ALL SELECT k + 1, far.b, xor(far.v >> 8, base.v) FROM far JOIN base ON base.b = far.v & 255 WHERE k < 400),
begins AS (SELECT 0 AS len, CAST(4294967295 AS BIGINT) AS v UNION ALL SELECT len + 1, xor(begins.v >> 8, base.v) FROM begins JOIN base ON base.b = begins.v & 255 WHERE len < 400),
runs AS (SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
named AS (SELECT doc_id, run, times, hex(encode(doc_id || ':' || run)) AS h FROM runs),
bytes AS (SELECT doc_id, run, length(h) // 2 AS len, unnest(range(length(h) // 2)) AS i, h FROM named),
parts AS (SELECT doc_id, run, len, bit_xor(v) AS v FROM bytes JOIN far ON far.k = len - 1 - i AND far.b = CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) GROUP BY ALL),
sums AS (SELECT doc_id, run, xor(xor(parts.v, begins.v), 4294967295) AS crc FROM parts JOIN begins USING (len)),
slips AS (SELECT times, CASE WHEN crc % 199 = 0 THEN substr(run, 1, CAST(crc % length(run) AS INTEGER)) || substr(run, CAST(crc % length(run) AS INTEGER) + 2) ELSE run END AS word FROM runs JOIN sums USING (doc_id, run)),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slips WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
ways AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT ways.word, forms.form, step + 1 FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN roots USING (word)
"""

ORACLES: dict[str, str] = {
    "op4_token_counts": TOKEN_COUNTS,
    "op6_suffix_dedup": SUFFIX_DEDUP,
    "op9_decontaminate": DECONTAMINATE,
    "op11_ball_search": BALL_SEARCH,
    "op13_spelling": SPELLING,
}
