"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

_SPLIT = "list_filter(regexp_split_to_array({text}, '[' || chr(9) || '-' || chr(13) || ' ]+'), lambda x: x <> '')"

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_SPLIT.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS p FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS same FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS class_id FROM n)
SELECT w.doc_id, cast(coalesce(k.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(k.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_SPLIT.format(text="coalesce(text, '')")} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM w WHERE len(words) >= 20),
wins AS (SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS t FROM starts),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS n FROM wins) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM again),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN ps IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(ps, k)), lambda k: words[k]), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN lost ON lost.doc_id = w.doc_id
"""

SPELLING = """
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
b AS (
  SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_transform(bytes, lambda x: cast(x AS BIGINT)), lambda a, x: xor(a // 256, crcs[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, t),
c AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT DISTINCT word, n, p, word[:p - 1] || word[p + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
l AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.p = b.p AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT w.word, w.n, d.word, d.n FROM w JOIN d ON w.word = d.cut
  UNION SELECT d.word, d.n, w.word, w.n FROM w JOIN d ON w.word = d.cut),
f AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM l GROUP BY word, n),
g AS (
  SELECT w.word, CASE WHEN near_n >= 2 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN f ON f.word = w.word),
u(word, root) AS (SELECT word, word FROM g WHERE form IS NULL UNION ALL SELECT g.word, u.root FROM g JOIN u ON g.form = u.word)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN u ON u.word = g.word
"""

SOURCE_MIX = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, cast(len({_SPLIT.format(text="coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, source_size, 2.0 * source_size AS cap, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, cast(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
o AS (SELECT cap, weight, sum(cap) OVER r AS given, sum(weight) OVER r AS filled, row_number() OVER r AS k FROM s WINDOW r AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
a AS (SELECT 1.5 * sum(source_size) AS budget, sum(weight) AS weights FROM s),
l AS (
  SELECT arg_min(level, k) AS level FROM (
    SELECT o.k, (budget - coalesce(p.given, 0)) / (weights - coalesce(p.filled, 0))::DOUBLE AS level, o.cap, o.weight FROM o LEFT JOIN o p ON p.k = o.k - 1, a)
  WHERE cap >= weight * level),
t AS (
  SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target,
    ('0x' || left(md5('12:' || coalesce(source, '')), 13))::BIGINT::DOUBLE / 4503599627370496 AS start FROM s, l),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5('12:' || coalesce(cast(doc_id AS VARCHAR), ''))) AS n FROM d)
SELECT k.doc_id, k.size, t.source_size, target, cast(k.size * CASE WHEN t.source_size = 0 THEN 0 ELSE
  least(2, floor(n * (target / t.source_size) + start) - floor((n - 1) * (target / t.source_size) + start)) END AS BIGINT) AS taken
FROM k JOIN t ON t.source IS NOT DISTINCT FROM k.source
"""

_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
g AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, cast(sum(len(terms)) AS BIGINT) AS words FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
p AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (
  SELECT p.k, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(terms) * docs) // words))) AS score
  FROM p JOIN d ON d.k = p.k JOIN w ON w.term = p.term, g),
t AS (SELECT item_id, k, cast(sum(times * score) AS BIGINT) AS score FROM s JOIN q ON q.term = s.term GROUP BY ALL),
r AS (SELECT item_id, d.doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, d.doc_id) AS rank FROM t JOIN d ON d.k = t.k WHERE score > 0)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op13_lexical_search": LEXICAL_SEARCH, "op12_source_mix": SOURCE_MIX, "op11_spelling_groups": SPELLING, "op2_ngram_join": NGRAM_JOIN, "op6_substring_dedup": SUBSTRING_DEDUP}
