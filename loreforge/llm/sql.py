"""SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words, len(list_filter(ws, lambda x: length(x) > 25)) AS n_long_words
  FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (2 * n_upper_words > n_words)::INT
  + 16 * (2 * n_dup_lines > n_lines)::INT + 32 * (10 * n_long_words > n_words)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, 'strict-1' AS policy, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f"""


#: One-line statements as the documents hold them, typed here and not taken from the operator: sentence, identifier, licence, rule.
OP4 = r"""
WITH known(sentence, id, licence, rule) AS (VALUES
 ('released under the mit license', 'mit-grant', 'MIT', 'mit-short'), ('licensed under the mit license', 'mit-grant', 'MIT', 'mit-short'),
 ('licensed under the apache license version 2 0', 'apache-2-grant', 'Apache-2.0', 'apache-short'), ('released under the apache license version 2 0', 'apache-2-grant', 'Apache-2.0', 'apache-short'),
 ('this work is licensed under the gnu general public license version 3', 'gpl-3-grant', 'GPL-3.0', 'gpl-3-short'), ('licensed under the gnu general public license version 3', 'gpl-3-grant', 'GPL-3.0', 'gpl-3-short'),
 ('this work is licensed under the gnu general public license version 2', 'gpl-2-grant', 'GPL-2.0', 'gpl-2-short'), ('licensed under the gnu general public license version 2', 'gpl-2-grant', 'GPL-2.0', 'gpl-2-short'),
 ('licensed under cc by 4 0', 'cc-by-4-grant', 'CC-BY-4.0', 'cc-by-short'), ('licensed under cc by sa 4 0', 'cc-by-sa-4-grant', 'CC-BY-SA-4.0', 'cc-by-sa-short'), ('licensed under cc by nc 4 0', 'cc-by-nc-4-grant', 'CC-BY-NC-4.0', 'cc-by-nc-short'),
 ('licensed under cc by nd 4 0', 'cc-by-nd-4-grant', 'CC-BY-ND-4.0', 'cc-by-nd-short'), ('licensed under cc0 1 0', 'cc0-grant', 'CC0-1.0', 'cc0-short'),
 ('all rights reserved', 'rights-reserved', 'proprietary', 'reserved'), ('this work is in the public domain', 'public-domain', 'public-domain', 'public-domain')),
 rank(rule, nth) AS (VALUES ('mit-short', 1), ('apache-short', 2), ('gpl-3-short', 3), ('gpl-2-short', 4), ('cc-by-short', 5), ('cc-by-sa-short', 6), ('cc-by-nc-short', 7), ('cc-by-nd-short', 8), ('cc0-short', 9), ('reserved', 10), ('public-domain', 11)),
 lines AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '([\x20\x09-\x0D][vV][.])[\x20\x09]+', '\1_', 'g'), '([.!?])[\x20\x09-\x0D]+', E'\\1\n', 'g'), '\n+') AS ls FROM documents),
 norm AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')), '^[\p{L}\p{N}]{1,2} (released under|licensed under|this work|all rights)', '\1')), lambda x: x <> '') AS ps FROM lines),
 hit AS (SELECT doc_id, at_place, k.* FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS at_place FROM norm) JOIN known k ON k.sentence = p)
SELECT d.doc_id, coalesce((SELECT string_agg(id, ',' ORDER BY at_place) FROM hit WHERE hit.doc_id = d.doc_id), '') AS sentence_ids,
  coalesce((SELECT string_agg(DISTINCT licence, ',' ORDER BY licence) FROM hit WHERE hit.doc_id = d.doc_id), '') AS licences,
  (SELECT count(*) FROM hit WHERE hit.doc_id = d.doc_id)::BIGINT AS n_matches,
  coalesce((SELECT string_agg(hit.rule || '@' || at_place, ',' ORDER BY nth, at_place) FROM hit JOIN rank ON rank.rule = hit.rule WHERE hit.doc_id = d.doc_id), '') AS rules FROM documents d"""

OP9 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
win AS (SELECT doc_id, i, md5(substr(t, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, t, unnest(range(0, length(t) // 2 - 199)) AS i FROM h)),
many AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM win WHERE m IN (SELECT m FROM many)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM run),
per AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, max(b) AS tail, string_agg(substr(t, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept || substr(t, 2 * tail + 1), t))) AS kept_sha256 FROM h LEFT JOIN per USING (doc_id)"""

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS.format(_FOLD.format('text'))} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_BENCH_WORDS.format(_FOLD.format('text'))} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(ws)) AS m, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes)),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON bw.g = dw.g AND bw.m = dw.m),
words AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS w FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


OP13 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o, step, list_transform(range(1, step), lambda i: ascii(o[i]) - 64) AS prior, ascii(o[step]) - 64 AS own FROM p, (SELECT unnest(range(1, 6)) AS step) WHERE length(o) = 5),
r AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS hit, list_bool_or(list_transform(prior, lambda i: fails[i])) IS TRUE AS gone, len(list_filter(fails, lambda x: x)) AS k FROM c, s),
g AS (SELECT part, o AS filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (hit AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g"""
