"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidewatch.llm import url_filter as url

_PARTS = """
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u)
"""


def _grams_sql() -> str:
    parts = (("h:", "host"), ("p:", "path"))
    found = [
        f"list_transform(range(1, length({c}) + {4 - n}), lambda i: '{tag}' || substr('^' || {c} || '$', i, {n}))"
        for tag, c in parts
        for n in url.GRAMS
    ]
    return " || ".join(found)


# The regression is trained in SQL too: the same kernel steps, as a recursive query.
OP1 = f"""
WITH RECURSIVE u AS (
  SELECT NULL::BIGINT AS page_id, url, verdict, true AS labelled
  FROM (VALUES {", ".join(f"('{u}', '{v}')" for u, v in url.LABELLED)}) AS v(url, verdict)
  UNION ALL SELECT page_id, url, NULL, false FROM pages
), parts AS ({_PARTS}),
g AS (
  SELECT row_number() OVER () AS rid, *, list_distinct(list_transform({_grams_sql()},
         lambda g: ('0x' || substr(md5(g), 1, 4))::BIGINT % {url.BUCKETS})) AS b FROM parts
), r AS (
  SELECT row_number() OVER (ORDER BY url) AS i, b, (verdict = 'block')::INT::DOUBLE AS y FROM g WHERE labelled
), k AS (
  SELECT x.i, any_value(x.y) AS y, list(len(list_intersect(x.b, z.b)) / (sqrt(len(x.b)) * sqrt(len(z.b))) + {url.OFFSET} ORDER BY z.i) AS k
  FROM r x, r z GROUP BY x.i
), kk AS (SELECT list(k ORDER BY i) AS k, list(y ORDER BY i) AS y FROM k),
s(t, a) AS (
  SELECT 0, list_transform(y, lambda v: 0.0::DOUBLE) FROM kk
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(a) + 1), lambda i:
         a[i] + {url.RATE} * (y[i] - 1 / (1 + exp(-list_dot_product(k[i], a))) - {url.DECAY} * a[i]))
  FROM s, kk WHERE t < {url.STEPS}
), alpha AS (SELECT unnest(a) AS a, generate_subscripts(a, 1) AS i FROM s WHERE t = {url.STEPS}),
w AS (
  SELECT b, sum(w) AS w FROM (SELECT a / sqrt(len(r.b)) AS w, unnest(r.b) AS b FROM alpha JOIN r USING (i)) GROUP BY b
), p AS (
  SELECT rid, sum(w.w) AS total FROM (SELECT rid, unnest(b) AS b FROM g WHERE NOT labelled) e JOIN w ON w.b = e.b GROUP BY rid
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM g WHERE NOT labelled
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN round((SELECT sum(a) FROM alpha) * {url.OFFSET} + coalesce(total, 0) / sqrt(greatest(len(b), 1)), 9) >= {url.LEAST_SCORE} THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN p USING (rid)
"""

# Shingle sets in full, pairs by shared shingles, components by repeated minima.
OP2 = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
), r(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.b, r.least FROM r JOIN e ON e.a = r.node
), c AS (SELECT node, min(least) AS least FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.least AS component_id, doc_id = c.least AS kept
FROM documents JOIN c ON c.node = doc_id LEFT JOIN n USING (doc_id)
"""

# All pairs of distinct word sets by shared words; prefix and size filters keep the pairs few.
OP3 = """
WITH l AS (
  SELECT doc_id, i - 1 AS line, t[i] AS x FROM (
    SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)
  )
), w AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda v: v <> ''))) AS s FROM l
), f AS (
  SELECT doc_id, line, s, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS turn FROM w WHERE len(s) > 0
), c AS (
  SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, s, len(s) AS n FROM f WHERE turn = 1
), t AS (SELECT id, n, unnest(s) AS v FROM c),
q AS (SELECT v, count(*) AS df FROM t GROUP BY v),
e AS (
  SELECT id, n, t.v, row_number() OVER (PARTITION BY id ORDER BY df, t.v) AS i FROM t JOIN q ON q.v = t.v
), p AS (SELECT * FROM e WHERE i <= n - ceil(n * 0.75) + 1),
k AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.v = b.v AND a.id < b.id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75
), z AS (
  SELECT DISTINCT k.b FROM k JOIN c x ON x.id = k.a JOIN c y ON y.id = k.b
  WHERE len(list_intersect(x.s, y.s)) * 100 >= (x.n + y.n - len(list_intersect(x.s, y.s))) * 75
), g AS (
  SELECT doc_id, line FROM f WHERE turn > 1
  UNION SELECT doc_id, line FROM c JOIN z ON z.b = c.id
), r AS (
  SELECT doc_id, count(*) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(r.n, 0)::BIGINT AS n_removed,
       coalesce(r.lines, '') AS removed_lines
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS x FROM pages),
t AS (
  SELECT page_id, octet_length(x) AS n, sha1(x) AS d, max(page_id) OVER (PARTITION BY x) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM t
"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), r(node, least) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.least FROM r JOIN l ON l.a = r.node
), c AS (SELECT node, min(least) AS least FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.least AS component_id, vec_id = c.least AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN k ON k.a = vec_id
"""

# Damage by a CRC-32 in SQL; repairs by the cheapest (cost, edits) per row and last role: e nothing, s, u, a.
OP12 = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1),
         lambda i: [ascii(substr(key, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
         4294967295::BIGINT) % 20 AS fate
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM f WHERE fate <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM d
), q AS (
  SELECT *, left(role, 1) AS c, CASE WHEN trimmed = '' THEN 'blank'
         WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), w AS (
  SELECT *, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS x,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM q
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM w GROUP BY conv_id
), b(conv_id, i, e, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {'c': 0::BIGINT, 's': ''}, {'c': 1000000000::BIGINT, 's': ''}, {'c': 5::BIGINT, 's': 'I'}, {'c': 10::BIGINT, 's': 'II'}
  FROM conversations
  UNION ALL
  SELECT conv_id, i, e, s, u, list_sort([a, {'c': u.c + 5, 's': u.s || 'I'}])[1] FROM (
    SELECT conv_id, i, e, s, a, list_sort([u, {'c': e.c + 5, 's': e.s || 'I'}, {'c': s.c + 5, 's': s.s || 'I'}, {'c': a.c + 5, 's': a.s || 'I'}])[1] AS u
    FROM (
      SELECT b.conv_id, w.i, {'c': e.c + 2, 's': e.s || 'D'} AS e,
             list_sort([{'c': b.s.c + 2, 's': b.s.s || 'D'}, {'c': e.c + t + x + CASE WHEN w.c = 's' THEN 0 ELSE 1000000000 END, 's': e.s || 'K'}])[1] AS s,
             list_sort([{'c': u.c + 2, 's': u.s || 'D'}] || list_transform([e, b.s, a], lambda y:
               {'c': y.c + t + x + CASE WHEN w.c = 'u' THEN 0 ELSE 1 END, 's': y.s || CASE WHEN w.c = 'u' THEN 'K' ELSE 'R' END}))[1] AS u,
             list_sort([{'c': a.c + 2, 's': a.s || 'D'},
               {'c': u.c + t + x + CASE WHEN w.c = 'a' THEN 0 ELSE 1 END, 's': u.s || CASE WHEN w.c = 'a' THEN 'K' ELSE 'R' END}])[1] AS a
      FROM b JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i + 1
    )
  )
), v AS (
  SELECT b.conv_id, list_sort([e, a])[1] AS best, g.* EXCLUDE (conv_id) FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
  WHERE b.i = coalesce(g.n, 0)
), l AS (
  SELECT conv_id, pos, substr(best.s, pos, 1) AS letter, length(replace(left(best.s, pos), 'I', '')) AS i
  FROM (SELECT *, unnest(range(1, length(best.s) + 1)) AS pos FROM v)
), m AS (
  SELECT l.conv_id, pos, letter, w.role, w.text, w.c, row_number() OVER (PARTITION BY l.conv_id ORDER BY pos) AS j
  FROM l LEFT JOIN w ON letter <> 'I' AND w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.i = l.i WHERE letter <> 'D'
), z AS (
  SELECT *, max(CASE WHEN j = 1 AND letter = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM m
), h AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS told FROM z GROUP BY conv_id
)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.s AS audit,
       sha256(coalesce(told, '')) AS repaired_sha256
FROM v LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM v.conv_id
"""

ORACLES = {
    "op1_url_filter": OP1, "op2_minhash_near_dedup": OP2, "op3_line_dedup": OP3, "op9_warc": OP9,
    "op10_embedding_near_dedup": OP10, "op12_conversation_repair": OP12,
}
