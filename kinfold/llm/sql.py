"""DuckDB SQL of queries that SQL can express, over whole tables and without the operators' methods."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows with a number, their words in order, and how many words they have.
_WORDS = rf"""
d AS (SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p, len(w) AS n FROM d)"""

SUBSTRINGS = rf"""
WITH {_WORDS},
long AS (SELECT rid, p, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS k FROM words WHERE n >= 50),
spans AS (SELECT long.rid, coalesce(doc_id, -9223372036854775808) AS id, p, md5(k) AS k FROM long JOIN d USING (rid) WHERE p <= n - 49),
low AS (SELECT k, min(id) AS least FROM spans GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS p FROM spans JOIN low USING (k) WHERE id > least),
lost AS (SELECT rid, count(*) AS n_removed FROM gone GROUP BY rid),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""

LINES = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS o, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT o, k, list_sort(list_distinct(regexp_extract_all(line, '{WORD}'))) AS w FROM (SELECT o, unnest(parts) AS line, unnest(range(0, len(parts))) AS k FROM d)),
lines AS (SELECT * FROM l WHERE len(w) > 0),
sets AS (SELECT row_number() OVER (ORDER BY min((o, k))) AS id, w, len(w) AS n, min((o, k)) AS first FROM lines GROUP BY w),
tokens AS (SELECT id, n, unnest(w) AS word FROM sets),
rare AS (SELECT word, count(*) AS often FROM tokens GROUP BY word),
ranked AS (SELECT id, n, word, row_number() OVER (PARTITION BY id ORDER BY often, word) AS place FROM tokens JOIN rare USING (word)),
prefixes AS (SELECT id, n, word FROM ranked WHERE place <= n - ceil(0.8::DOUBLE * n - 1e-9) + 1),
found AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefixes a JOIN prefixes b ON a.word = b.word AND a.id > b.id AND least(a.n, b.n) >= 0.8::DOUBLE * greatest(a.n, b.n) - 1e-9),
gone AS (SELECT DISTINCT f.a AS id FROM found f JOIN sets x ON f.a = x.id JOIN sets y ON f.b = y.id WHERE len(list_intersect(x.w, y.w))::DOUBLE / (x.n + y.n - len(list_intersect(x.w, y.w))) >= 0.8::DOUBLE),
kept AS (SELECT first[1] AS o, string_agg(first[2]::VARCHAR, ',' ORDER BY first[2]) AS kept_lines, count(*) AS n FROM (SELECT [first[1], first[2]] AS first, id FROM sets) ANTI JOIN gone USING (id) GROUP BY 1),
counts AS (SELECT o, count(*) AS n_lines FROM lines GROUP BY o)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (coalesce(n_lines, 0) - coalesce(n, 0))::INTEGER AS n_removed, coalesce(kept_lines, '') AS kept_lines FROM d LEFT JOIN counts USING (o) LEFT JOIN kept USING (o)
"""

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _items(table: str, key: str) -> str:
    return f"SELECT row_number() OVER () AS rid, {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_ITEM_WORD}') AS w FROM {table}"


LEAKS = rf"""
WITH d AS ({_items("documents", "doc_id")}), b AS ({_items("benchmark", "item_id")}),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bw),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
ahead AS (SELECT rid, p, list(word) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
spans AS (SELECT rid, p, s.n, array_to_string(l[1:s.n], ' ') AS k FROM ahead, (SELECT DISTINCT n FROM items) s WHERE len(l) >= s.n),
hits AS (SELECT rid, p, n, item_id FROM spans JOIN items USING (n, k)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

QUALITY = rf"""
WITH {_WORDS},
triples AS (SELECT rid, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS k FROM words WINDOW o AS (PARTITION BY rid ORDER BY p)),
twice AS (SELECT rid, k FROM triples WHERE k IS NOT NULL GROUP BY rid, k HAVING count(*) > 1),
again AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM triples JOIN twice USING (rid, k)) GROUP BY rid),
raw AS (SELECT rid, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
lines AS (SELECT *, regexp_extract_all(line, '{WORD}') AS lw FROM raw),
used AS (SELECT rid, source, text, line, len(lw) AS n, translate(array_to_string(lw, ' '), '{UPPER}', '{LOWER}') AS k FROM lines WHERE len(lw) > 0),
repeated AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM used GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS texts FROM d GROUP BY source),
often AS (SELECT source, k, count(DISTINCT text) AS texts FROM used GROUP BY source, k),
above AS (SELECT o.source, k FROM often o JOIN hosts h ON o.source IS NOT DISTINCT FROM h.source WHERE o.texts > 10 AND o.texts > sqrt(h.texts)),
lost AS (SELECT rid, sum(n) AS removed_words FROM used u JOIN above a ON u.source IS NOT DISTINCT FROM a.source AND u.k = a.k GROUP BY rid),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN again USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.8::DOUBLE * n_words AS kept FROM base
"""

#: Classes by recursion over the links; ids are taken to be unique.
NEAR = rf"""
WITH RECURSIVE {_WORDS},
ahead AS (SELECT rid, p, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM words),
shingles AS (SELECT DISTINCT rid, md5(k) AS k FROM ahead WHERE p <= greatest(n - 4, 1)),
sizes AS (SELECT rid, count(*) AS size FROM shingles GROUP BY rid),
both_ AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.k = b.k AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON a = x.rid JOIN sizes y ON b = y.rid WHERE c::DOUBLE / (x.size + y.size - c) >= 0.8::DOUBLE),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS rid, min(doc_id) AS class_id FROM reach JOIN d ON b = d.rid GROUP BY a),
counts AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(w)::BIGINT AS n_words, class_id, coalesce(n_links, 0)::BIGINT AS n_links, doc_id = class_id AS stays FROM d JOIN classes USING (rid) LEFT JOIN counts USING (rid)
"""
