"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_DIGIT = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"
_PAIR = f"({_DIGIT.format('i * 5 // 4 + 1')} * 16 + {_DIGIT.format('i * 5 // 4 + 2')})"
#: Five bits of the hexadecimal digest for each of 32 signs.
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_PAIR} // [8, 4, 2, 1][CAST(i * 5 % 4 + 1 AS BIGINT)] % 32 + 1 AS BIGINT), 1)), '')"

WARC = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h, MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS newest FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
FROM p
"""

_ESCAPED = r"length(regexp_replace({}, '(\\*)(<s>|</s>|\[/?(?:INST|OUT|ROLE|NAME)\])', '\\\1\2', 'g'))"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(3 + SUM({_ESCAPED.format('text')} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 23 + {_ESCAPED.format('role')} END) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII signs, bit by bit."""
    bits = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {bits}), 4294967295)"


def _leaf(*columns: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in columns) + ")"


_RISE = "SELECT level + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM {0} WHERE n > 1 GROUP BY level, g, n, i // 2"
_CLIMB = """SELECT w.doc_id, w.leaf, w.g, w.level + 1, w.i // 2, (w.n + 1) // 2, w.proof || COALESCE(s.digest, ''),
  sha256(CASE WHEN w.i % 2 = 1 THEN s.digest || w.node ELSE w.node || COALESCE(s.digest, '') END)
  FROM {0} w LEFT JOIN {1} s ON s.g = w.g AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1"""
MERKLE = f"""
WITH RECURSIVE
l AS MATERIALIZED (SELECT doc_id, COALESCE('=' || lang, '') AS g, {_leaf('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
  CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('doc_id', 'source', 'lang', '(n_chars + 1)', 'text')} END AS other FROM documents),
p AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, COUNT(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT 0 AS level, g, i, n, leaf AS digest FROM p UNION ALL {_RISE.format('t')}),
nodes AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT g AS label, digest, ROW_NUMBER() OVER (ORDER BY g) - 1 AS i, COUNT(*) OVER () AS n FROM nodes WHERE n = 1),
u AS (SELECT 0 AS level, '' AS g, i, n, digest FROM s UNION ALL {_RISE.format('u')}),
tops AS MATERIALIZED (SELECT * FROM u),
w AS (SELECT doc_id, leaf, g, 0 AS level, i, n, '' AS proof, COALESCE(other, leaf) AS node FROM p UNION ALL {_CLIMB.format('w', 'nodes')}),
half AS MATERIALIZED (SELECT w.*, s.i AS place, s.n AS many, s.digest AS subroot FROM w JOIN s ON s.label = w.g WHERE w.n = 1),
v AS (SELECT doc_id, leaf || '/' || subroot AS leaf, '' AS g, 0 AS level, place AS i, many AS n, proof, node FROM half UNION ALL {_CLIMB.format('v', 'tops')})
SELECT doc_id, leaf[:64] AS leaf, leaf[66:] AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.digest AS verified
FROM v, (SELECT digest FROM tops WHERE n = 1) r WHERE v.n = 1
"""


TRIE = f"""
WITH c AS MATERIALIZED (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
    ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS rn FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT conv_id, rn, sha256(strlen(role) || ':' || role || text) AS key, strlen(text) AS size FROM c),
h AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM k)),
r AS (SELECT h.conv_id, 0 AS half, k.rn, key, size FROM h JOIN k ON k.conv_id = h.base AND k.rn <= h.h
  UNION ALL SELECT h.conv_id, 1, k.rn, key, size FROM h JOIN k ON k.conv_id = h.conv_id AND k.rn > h.h),
q AS (SELECT conv_id, size, ROW_NUMBER() OVER o AS depth, string_agg(key, '') OVER o AS whole FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY half, rn ROWS UNBOUNDED PRECEDING)),
m AS MATERIALIZED (SELECT conv_id, depth, sha256(whole) AS node, sha256(whole[:-65]) AS parent, size FROM q UNION ALL SELECT conv_id, 0, sha256(''), NULL, 0 FROM h),
e AS (SELECT *, depth = MAX(depth) OVER (PARTITION BY conv_id) AS ends FROM m),
n AS MATERIALIZED (SELECT MIN(conv_id) AS conv_id, depth, node, parent, COUNT(*) AS n_convs, (COUNT(*) - 1) * MAX(size) AS gain,
  sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY depth, node, parent),
b AS MATERIALIZED (SELECT n.*, COALESCE(x.kids, 0) AS kids FROM n LEFT JOIN (SELECT parent AS node, COUNT(*) AS kids FROM n GROUP BY parent) x USING (node)),
u AS (SELECT m.node, CAST(COUNT(*) FILTER (WHERE b.kids = 0) AS BIGINT) AS n_leaves, CAST(SUM(b.gain) AS BIGINT) AS saved_tokens FROM b JOIN m ON m.conv_id = b.conv_id AND m.depth <= b.depth GROUP BY m.node)
SELECT b.conv_id, CAST(b.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, b.n_convs, b.kids AS n_children, n_leaves, saved_tokens, b.ends_sha256
FROM b JOIN u USING (node) LEFT JOIN n p ON p.node = b.parent
"""
VECTORS = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
