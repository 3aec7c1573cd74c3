"""SQL of operators that need several steps: built from one pattern per step."""

from __future__ import annotations


def lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd iterations over parts of whole-number vectors, one pair of common tables a round."""
    gap = "list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, pos, c, arg_min(entry, (gap, entry)) AS entry, min(gap) AS gap
  FROM (SELECT p.*, b.entry, {gap} AS gap FROM p JOIN b{r} b USING (pos)) GROUP BY vec_id, label, pos, c)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT pos, entry, i, sum(c[i]) AS s, count(*) AS n FROM a{r}, range(1, len(c) + 1) t(i) GROUP BY pos, entry, i),
b{r + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b
  LEFT JOIN (SELECT pos, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY pos, entry) m USING (pos, entry))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * (len(v) // {parts}) + 1 : (pos + 1) * (len(v) // {parts})] AS c FROM k, range({parts}) t(pos)),
b0 AS MATERIALIZED (SELECT * FROM (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, c FROM p) WHERE entry < {entries}),{",".join(steps)},
v AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(gap)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v
"""


#: crc32 of a decimal number, bit by bit; the polynomial is the usual one, reflected.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END::BIGINT))), 4294967295::BIGINT)"""

TRIE_SQL = r"""
WITH o AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, conv_id - conv_id % 20 AS base, CRC % 4 AS h FROM o),
q AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.base),
m AS MATERIALIZED (SELECT conv_id, d, len(s) AS n, s[1:d] AS k FROM q, range(0, len(s) + 1) t(d)),
g AS MATERIALIZED (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) END AS own FROM m GROUP BY k, d),
c AS MATERIALIZED (SELECT g.*, coalesce(x.n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM g
  LEFT JOIN (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1) x USING (k) LEFT JOIN g p ON g.depth > 0 AND p.k = g.k[1:g.depth - 1]),
r AS (SELECT k[1:d] AS k, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM c, range(0, depth + 1) t(d) GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM c JOIN r USING (k)
""".replace("CRC", CRC32.format("conv_id"))
