"""DuckDB SQL of the queries on shards and conversations.

They take other ways than the operators: checksums byte by byte, repairs with whole audits and texts in a recursion over rows, the trie by lists
of turns.
"""

from __future__ import annotations

from acrelane.llm.hilbert import BITS, DIMENSIONS, curve_steps


def _checksum_table() -> str:
    """Remainders of single bytes by the polynomial of CRC-32, as a list."""
    values = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        values.append(value)
    return "[0::BIGINT, " + ", ".join(map(str, values[1:])) + "]"


def _crc32(data: str) -> str:
    """Of a list of bytes."""
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, {_checksum_table()}[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _digits(text: str) -> str:
    """Bytes of a text of ASCII characters."""
    return f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)"


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"


def _curve(corners: str, n: int) -> str:
    """The place on the curve by a list of corners, most significant first; the state is kept in the lowest seven bits."""
    digits, states = ("[" + ", ".join(f"{v}::BIGINT" for v in table) + "]" for table in curve_steps(n))
    at = f"((a & 127) * {1 << n} + b + 1)"
    return f"list_reduce({corners}, lambda a, b: ((((a >> 7) * {1 << n} + {digits}[{at}]) << 7) | {states}[{at}]), 0::BIGINT) >> 7"


def _buckets(i: int, name: str) -> str:
    """Values of a dimension with their buckets: the first value of each of the shares is a cut."""
    return f"""c{i} AS (SELECT {name} AS v, count(*) AS n FROM documents WHERE {name} IS NOT NULL GROUP BY {name}),
g{i} AS (SELECT v, floor((sum(n) OVER (ORDER BY v) - n) * {1 << BITS} / sum(n) OVER ()) AS share FROM c{i}),
q{i} AS (SELECT v, dense_rank() OVER (ORDER BY share) - 1 AS b FROM g{i})"""


SHARDS = f"""
WITH {", ".join(_buckets(i, name) for i, name in enumerate(DIMENSIONS))},
x AS (SELECT d.doc_id, octet_length(encode(coalesce(d.text, ''))) + 8 AS size, {_crc32(_bytes("coalesce(d.text, '')"))} AS crc,
  {", ".join(f"coalesce(q{i}.b, 0)::BIGINT AS b{i}" for i in range(len(DIMENSIONS)))}
  FROM documents d {" ".join(f"LEFT JOIN q{i} ON q{i}.v = d.{name}" for i, name in enumerate(DIMENSIONS))}),
y AS (SELECT *, {_curve(f"list_transform(range({BITS} - 1, -1, -1), lambda level: {' + '.join(f'((b{i} >> level) & 1) * {1 << i}' for i in range(len(DIMENSIONS)))})", len(DIMENSIONS))} AS curve FROM x),
z AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM y)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, (r * 24 // n)::INT AS shard, r - ((r * 24 // n) * n + 23) // 24 AS slot, NULL::INT AS grown_shard, curve FROM z
"""

REPAIR = fr"""
WITH RECURSIVE
raw AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
hit AS (SELECT c, turn, role, text, {_crc32(_digits('id'))} % 20 AS kind FROM raw),
hurt AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE kind <> 0),
d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS k, left(role, 1) AS ini FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 AS again FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault,
  lag(ini) OVER (PARTITION BY c ORDER BY k) AS before FROM seen),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE k > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM f GROUP BY c),
-- tops: 0 nothing yet, 1 system, 2 user waits, 3 pairs; ins: turns that are inserted, act: what is done with a row
ins(a, letters, lines, b) AS (VALUES (0, '', '', 0), (1, '', '', 1), (2, '', '', 2), (3, '', '', 3), (0, 'I', chr(10) || 'user:', 2), (1, 'I', chr(10) || 'user:', 2), (2, 'I', chr(10) || 'assistant:', 3), (3, 'I', chr(10) || 'user:', 2),
  (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (2, 'II', chr(10) || 'assistant:' || chr(10) || 'user:', 2), (3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3)),
act(a, letter, role, b, price) AS (VALUES (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
  (0, 'R', 'user', 2, 3), (1, 'R', 'user', 2, 3), (2, 'R', 'assistant', 3, 3), (3, 'R', 'user', 2, 3)),
s AS (
  SELECT c, 0::BIGINT AS k, 0 AS top, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}} AS m FROM sums
  UNION ALL
  SELECT s.c, s.k + 1, e.b, min({{'cost': s.m.cost + 3 * length(i.letters) + e.price + CASE WHEN e.letter <> 'D' AND f.fault = 't' THEN 3 ELSE 0 END,
    'audit': s.m.audit || i.letters || e.letter,
    'body': s.m.body || i.lines || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || e.role || ':' || f.text END}})
  FROM s JOIN f ON f.c IS NOT DISTINCT FROM s.c AND f.k = s.k + 1 JOIN ins i ON i.a = s.top JOIN act e ON e.a = i.b AND (e.letter = 'D' OR f.fault IN ('-', 't') AND (e.letter = 'R' OR e.role = f.ini))
  GROUP BY s.c, s.k, e.b),
done AS (SELECT s.c, min({{'cost': s.m.cost + 3 * length(i.letters), 'audit': s.m.audit || i.letters, 'body': s.m.body || i.lines}}) AS m
  FROM s JOIN sums ON sums.c IS NOT DISTINCT FROM s.c AND sums.n = s.k JOIN ins i ON i.a = s.top AND i.b IN (0, 3) GROUP BY s.c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(done.m.cost, 0)::BIGINT AS cost, coalesce(done.m.audit, '') AS audit, sha256(coalesce(substr(done.m.body, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums ON sums.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.c IS NOT DISTINCT FROM o.conv_id
"""

TRIE = fr"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY k) AS xs FROM t GROUP BY c),
asked AS (SELECT c, xs, {_crc32(_digits('c::VARCHAR'))} % 4 AS h, c - c % 20 AS base FROM own),
built AS (SELECT a.c, list_concat(CASE WHEN b.xs IS NULL THEN [] ELSE b.xs[1:a.h] END, a.xs[a.h + 1:]) AS xs FROM asked a LEFT JOIN own b ON b.c = a.base),
pre AS (SELECT c, d, xs[1:d] AS p, len(xs) AS n FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].t, '[^\x20\x09-\x0D]+')) END AS saved FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
low AS (SELECT v.*, coalesce(k.n, 0) AS n_children FROM node v LEFT JOIN kid k ON k.p = v.p AND k.d = v.d),
up AS (SELECT p[1:u] AS p, u AS d, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT p, saved, n_children, unnest(range(0, d + 1)) AS u FROM low) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM low v JOIN up u ON u.p = v.p AND u.d = v.d LEFT JOIN node q ON v.d > 0 AND q.d = v.d - 1 AND q.p = v.p[1:v.d - 1]
"""
