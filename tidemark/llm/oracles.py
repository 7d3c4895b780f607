"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x20\x09-\x0D]+')"
_PLAIN = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LM = f"""
WITH d AS (SELECT doc_id, coalesce({_SPACED}, []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i-1] || ' ' || ws[i] END AS g2, CASE WHEN i > 2 THEN ws[i-2] || ' ' || ws[i-1] || ' ' || ws[i] END AS g3, CASE WHEN i > 1 THEN ws[i-1] END AS c1, CASE WHEN i > 2 THEN ws[i-2] || ' ' || ws[i-1] END AS c2 FROM p),
o1 AS (SELECT doc_id, g1 AS g, count(*) AS n FROM g GROUP BY ALL), o2 AS (SELECT doc_id, g2 AS g, count(*) AS n FROM g WHERE g2 IS NOT NULL GROUP BY ALL), o3 AS (SELECT doc_id, g3 AS g, count(*) AS n FROM g WHERE g3 IS NOT NULL GROUP BY ALL),
l1 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS n FROM o1), l2 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS n FROM o2), l3 AS (SELECT doc_id, g, sum(n) OVER (PARTITION BY g) - n AS n FROM o3),
t AS (SELECT sum(len(ws)) AS n FROM d),
x AS (SELECT g.doc_id, g.i, a1.n AS n1, a2.n AS n2, a3.n AS n3, b1.n AS k1, b2.n AS k2, t.n - len(d.ws) AS base, t.n AS total FROM g JOIN d USING (doc_id) CROSS JOIN t
 JOIN l1 a1 ON a1.doc_id = g.doc_id AND a1.g = g.g1 LEFT JOIN l2 a2 ON a2.doc_id = g.doc_id AND a2.g = g.g2 LEFT JOIN l3 a3 ON a3.doc_id = g.doc_id AND a3.g = g.g3
 LEFT JOIN l1 b1 ON b1.doc_id = g.doc_id AND b1.g = g.c1 LEFT JOIN l2 b2 ON b2.doc_id = g.doc_id AND b2.g = g.c2),
s AS (SELECT doc_id, CASE WHEN n3 > 0 THEN log10(n3::DOUBLE / k2) WHEN n2 > 0 THEN log10(n2::DOUBLE / k1) + CASE WHEN i > 2 THEN log10(0.4) ELSE 0 END
 ELSE CASE WHEN n1 > 0 AND base > 0 THEN log10(n1::DOUBLE / base) ELSE log10(1.0 / total) END + log10(0.4) * least(i - 1, 2) END AS s,
 CASE WHEN i = 1 THEN true WHEN i = 2 THEN n2 > 0 ELSE n3 > 0 END AS seen FROM x)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, count(*) FILTER (WHERE s.seen) AS n_seen, count(*) FILTER (WHERE NOT s.seen) AS n_backed_off, round(coalesce(sum(s.s), 0.0), 4) AS log10_sum, CASE WHEN len(d.ws) > 0 THEN round(sum(s.s) / len(d.ws), 6) END AS log10_mean
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id, d.ws
"""

LEAKS = f"""
WITH d AS (SELECT doc_id, coalesce({_PLAIN}, []) AS ws FROM documents),
b AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
spots AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, ws FROM d, (SELECT DISTINCT m FROM w) WHERE len(ws) >= m),
occ AS (SELECT DISTINCT spots.doc_id, spots.i, spots.m, w.item_id FROM spots JOIN w ON spots.m = w.m AND array_to_string(spots.ws[spots.i : spots.i + spots.m - 1], ' ') = w.w),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items, sha256(coalesce(items.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CONTROL = r"/?s(?: e=\d+)?>|</?SYS>>|/?INST\]|/?OUT\]|/?ROLE"
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
r AS (SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 WHEN 'system' THEN 15 ELSE 14 + length(role) END + 10
 + CASE WHEN regexp_matches(text, '[<\\[](?:{_CONTROL})') THEN 4 + length(regexp_replace(text, '([<\\[])(\\\\*)({_CONTROL})', '\\1\\\\\\2\\3', 'g')) ELSE length(text) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM r GROUP BY conv_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SPACED}, []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4])) WHEN len(ws) > 0 THEN [hash(ws)] ELSE [] END) AS hs FROM d),
u AS (SELECT doc_id, unnest(hs) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.h = b.h AND a.doc_id != b.doc_id GROUP BY ALL),
links AS (SELECT p.a, p.b FROM pairs p JOIN s x ON p.a = x.doc_id JOIN s y ON p.b = y.doc_id WHERE 100 * p.n >= 75 * (len(x.hs) + len(y.hs) - p.n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.hs)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id, s.doc_id <= coalesce(min(r.b), s.doc_id) AS kept FROM s LEFT JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.hs
"""

#: crc32, folded over the bytes of the text, eight shifts each.
_SHIFTED = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
SHARDS = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce('=' || source, '') AS s, md5('tidemark:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY s) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, s, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, strlen(text)::BIGINT + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: {_SHIFTED}), 4294967295::BIGINT) AS text_crc32,
'rows' AS law, (pos * 24 // n)::INTEGER AS shard, pos - ((pos * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard FROM p
"""

_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({}), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: " + _SHIFTED + "), 4294967295::BIGINT)"

TRIE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, {_CRC32.format("encode(c::VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
o AS (SELECT cs.c, 0 AS own, t.pos, t.r, t.x FROM cs JOIN t ON t.c = cs.c - cs.c % 20 AND t.pos < cs.h UNION ALL SELECT cs.c, 1, t.pos, t.r, t.x FROM cs JOIN t ON t.c = cs.c AND t.pos >= cs.h),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM o),
m AS (SELECT c, d, md5(string_agg(md5(r) || md5(x), '') OVER (PARTITION BY c ORDER BY d)) AS k, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM n UNION ALL SELECT c, 0, '', 0 FROM cs),
v AS (SELECT k, d, min(c) AS c, count(*) AS n_convs, min(w) AS w FROM m GROUP BY k, d),
up AS (SELECT v.k, v.d, p.k AS pk FROM v JOIN m p ON p.c = v.c AND p.d = v.d - 1),
kids AS (SELECT pk AS k, count(*) AS n_children FROM up GROUP BY pk),
below AS (SELECT a.k, a.d, sum((kids.k IS NULL)::INT) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved FROM v LEFT JOIN kids ON kids.k = v.k JOIN m a ON a.c = v.c AND a.d <= v.d GROUP BY a.k, a.d),
e AS (SELECT k, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k, max(d) AS d FROM m GROUP BY c) GROUP BY k, d)
SELECT v.c AS conv_id, v.d AS depth, pv.c AS parent_conv_id, v.n_convs, coalesce(kids.n_children, 0) AS n_children, below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM v LEFT JOIN up ON up.k = v.k AND up.d = v.d LEFT JOIN v pv ON pv.k = up.pk AND pv.d = v.d - 1 LEFT JOIN kids ON kids.k = v.k JOIN below ON below.k = v.k AND below.d = v.d LEFT JOIN e ON e.k = v.k AND e.d = v.d
"""

RESAMPLED = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_PLAIN}, []) AS ws FROM documents), b AS (SELECT {_PLAIN} AS ws FROM benchmark WHERE text IS NOT NULL),
f AS (SELECT row, f, count(*) AS n FROM (SELECT row, unnest([array_to_string(ws[i : i + k], ' ') FOR k IN range(0, 3) IF i + k <= len(ws)]) AS f FROM (SELECT row, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)) GROUP BY ALL),
g AS (SELECT f, count(*) AS n FROM (SELECT unnest([array_to_string(ws[i : i + k], ' ') FOR k IN range(0, 3) IF i + k <= len(ws)]) AS f FROM (SELECT ws, unnest(range(1, len(ws) + 1)) AS i FROM b)) GROUP BY ALL),
bits AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS tab FROM range(0, 256) r(c)),
h AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT f FROM f UNION SELECT f FROM g), bits),
s AS (SELECT bucket, sum(n) AS n FROM f JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, sum(n) AS n FROM g JOIN h USING (f) GROUP BY bucket),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, sum(f.n)::BIGINT AS n_features, sum(f.n * gain)::BIGINT AS weight FROM f JOIN h USING (f) JOIN gain USING (bucket) GROUP BY row),
x AS (SELECT d.row, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_lm_score": LM, "op6_sharding": SHARDS, "op7_decontaminate": LEAKS, "op8_chat": CHAT, "op10_near_dups": NEAR, "op12_prefix_trie": TRIE, "op13_resampling": RESAMPLED}
