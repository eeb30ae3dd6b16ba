"""DuckDB SQL of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

#: The CRC-32 table as a list of 256 numbers: eight steps of the reflected polynomial.
_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS b)))"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; needs ``tab`` of crc_table in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")


OP11_SPELLING_VARIANTS = f"""
WITH RECURSIVE {_TABLE},
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM runs, crc_table),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, first({{'w': near, 'n': n}} ORDER BY n DESC, near) AS b
  FROM (SELECT p.word, p.near, w.n FROM pairs p JOIN words w ON p.near = w.word) GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b['n'] >= 10 * w.n THEN b['w'] END AS form,
    CASE WHEN b['n'] >= 10 * w.n THEN b['n'] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""

OP12_PREFIX_TRIE = f"""
WITH {_TABLE},
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, count(*) AS n FROM turns GROUP BY c),
heads AS (SELECT c, n, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h, c - c % 100 AS lead FROM own, crc_table),
rebuilt AS (
  SELECT heads.c, pos, role, text FROM heads JOIN turns ON turns.c = lead AND pos <= h
  UNION ALL
  SELECT heads.c, least(h, coalesce(l.n, 0)) + pos - h, role, text
  FROM heads JOIN turns ON turns.c = heads.c AND pos > h LEFT JOIN own l ON l.c = lead),
prefixes AS MATERIALIZED (
  SELECT c, 0 AS d, '' AS k, 0 AS chars, false AS is_turn FROM own
  UNION ALL
  SELECT c, pos, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING),
    length(text), true FROM rebuilt),
nodes AS MATERIALIZED (SELECT d, k, min(c) AS rep, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY d, k),
paths AS MATERIALIZED (SELECT p.c, p.d, n.rep FROM prefixes p JOIN nodes n USING (d, k)),
linked AS MATERIALIZED (
  SELECT n.rep, n.d, n.n_convs, n.chars, p.rep AS parent FROM nodes n LEFT JOIN paths p ON p.c = n.rep AND p.d = n.d - 1),
children AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
known AS MATERIALIZED (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children USING (rep, d)),
totals AS (
  SELECT a.rep, a.d, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM known x JOIN paths a ON a.c = x.rep AND a.d <= x.d GROUP BY ALL),
ends AS (
  SELECT rep, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM paths
  JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT rep AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known JOIN totals USING (rep, d) LEFT JOIN ends USING (rep, d)
"""

ORACLE = {"op11_spelling_variants": OP11_SPELLING_VARIANTS, "op12_prefix_trie": OP12_PREFIX_TRIE}
