"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# (kind, rank, pattern, group of the value, least length of the value)
_KINDS = [
    ("assign", 0, r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 2, r"[0-9a-f]+", 0, 16),
    ("generic", 3, r"[A-Za-z0-9+/_=-]{20,}", 0, 0),
]


def _found(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT row, doc_id, owner, section, '{kind}' AS kind, {rank} AS rank, v AS value,
           list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a, length(m[i]) AS size
    FROM (SELECT row, doc_id, owner, section, p, m, unnest(g) AS v, generate_subscripts(g, 1) AS i FROM (
        SELECT row, doc_id, owner, section, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m,
               regexp_extract_all(t, '{pattern}', {group}) AS g FROM d WHERE regexp_matches(t, '{pattern}')))
    WHERE length(v) >= {least}"""


OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS owner, coalesce(lang, chr(0)) AS section FROM documents),
every AS ({" UNION ALL ".join(_found(*k) for k in _KINDS)}),
base AS (SELECT *, a + size AS z FROM every WHERE rank < 3),
extra AS (SELECT *, a + size AS z FROM every e WHERE rank = 3 AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = e.row AND e.a < b.z AND b.a < e.a + e.size)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
held AS (SELECT value, count(DISTINCT owner) <= 2 AND count(DISTINCT (owner, section)) <= 4 AS live FROM spans GROUP BY value),
judged AS (SELECT s.*, live, kind || ':' || a::BIGINT || ':' || z::BIGINT AS said FROM spans s JOIN held USING (value)),
per AS (SELECT row, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
        string_agg(said, ',' ORDER BY a, rank) FILTER (rank < 3) AS base_said, string_agg(said, ',' ORDER BY a, rank) FILTER (rank < 3 OR live) AS spans,
        count(*) FILTER (rank < 3 AND live) AS n_live, count(*) FILTER (rank < 3 AND NOT live) AS n_copied FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_said, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN per USING (row)
"""

_COMPONENTS = """
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(node, seen) AS (SELECT id, id FROM ids UNION SELECT ways.b, walk.seen FROM walk JOIN ways ON ways.a = walk.node),
comp AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
"""

OP4 = f"""
WITH RECURSIVE ok AS (
    SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.98),
ids AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept, 1.0::DOUBLE AS recall
FROM embeddings JOIN comp ON comp.node = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS t
       FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT row, n, k, array_to_string(w[k:k + n - 1], ' ') AS t
       FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT row, k, dw.n, item FROM dw JOIN iw USING (n, t)),
words AS (SELECT row, count(*) AS n_hit FROM (SELECT DISTINCT row, unnest(range(k, k + n)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hits GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ids AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10 = r"""
WITH r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
b AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS bare FROM pages),
u AS (SELECT row, page_id, translate(regexp_extract(bare, '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(bare, length(regexp_extract(bare, '(?s)^[^/]*')) + 1) AS path FROM b),
best AS (SELECT row, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
         FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (row)
"""

_TURN = "md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
_CRC32 = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
          "lambda acc, x: list_reduce(list_prepend(xor(acc, x), range(8)), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))), 4294967295::BIGINT)")

OP11 = f"""
WITH t AS (SELECT conv_id, {_TURN} AS key, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS own, {_CRC32} % 9 AS h, conv_id - conv_id % 5 AS source FROM t GROUP BY conv_id),
g AS (SELECT i.conv_id, i.source, i.h, least(i.h, coalesce(s.own, 0)) AS given FROM ids i LEFT JOIN ids s ON s.conv_id = i.source),
turns AS (SELECT g.conv_id, pos AS d, key, size FROM g JOIN t ON t.conv_id = g.source AND pos <= given
          UNION ALL SELECT g.conv_id, given + pos - h, key, size FROM g JOIN t ON t.conv_id = g.conv_id AND pos > h
          UNION ALL SELECT conv_id, 0, '', 0 FROM g),
named AS (SELECT conv_id, d, size, md5(string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, max(d) OVER (PARTITION BY conv_id) = d AS stops FROM turns),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM named),
nodes AS (SELECT node, any_value(parent) AS parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
          coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '') AS said FROM steps GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * size AS worth FROM nodes LEFT JOIN kids USING (node)),
under AS (SELECT s.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.worth)::BIGINT AS saved_tokens
          FROM steps s JOIN own u ON u.conv_id = s.conv_id AND u.depth >= s.d GROUP BY s.node)
SELECT own.conv_id, own.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, under.n_leaves, under.saved_tokens, sha256(own.said) AS ends_sha256
FROM own JOIN under ON under.node = own.node LEFT JOIN own p ON p.node = own.parent
"""

_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_DRAW = "('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::BIGINT"

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS unit, {", ".join(f"{_DRAW.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM documents),
c AS (SELECT doc_id, t, unit, len(unit) AS n, least(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS a, greatest(h1 % (len(unit) + 1), h2 % (len(unit) + 1)) AS z,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(unit[1:a], '') AS x, array_to_string(unit[a + 1:z], '') AS y, array_to_string(unit[z + 1:], '') AS w FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || w || '<M>' || y ELSE '<S>' || w || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(x || y || w) AS restored_sha256
FROM p
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
l AS (SELECT row, doc_id, id, unnest(line) AS line, generate_subscripts(line, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
held AS (SELECT key, max(id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5),
j AS (SELECT k.*, held.key IS NOT NULL AND k.id <> held.keeper AS gone FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row, doc_id
"""

ORACLE = {"op3_secrets": OP3, "op4_embeddings": OP4, "op7_contamination": OP7, "op8_minhash": OP8, "op10_urls": OP10, "op11_conversation_trie": OP11,
          "op12_fill_in_middle": OP12, "op13_line_dedup": OP13}
