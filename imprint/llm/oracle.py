"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# crc32 of a string's bytes (ASCII), eight shift steps a byte; 3988292384 is the reversed polynomial
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(
    list_concat([xor(s, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""


def _part(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(map(_part, fields))})"


# up: every level of the trees of rows (g, i, h); over: the paths of rows (d, g, i, x), folded level by level
_UP = """{0} AS (
  SELECT 0 AS lvl, g, i, h FROM {1}
  UNION ALL
  SELECT lvl + 1, g, i // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {0}) WHERE n > 1 GROUP BY lvl, g, i // 3)"""
_OVER = """{0} AS (
  SELECT 0 AS lvl, d, g, i, x, CAST({1} AS VARCHAR) AS proof FROM {2}
  UNION ALL
  SELECT f.lvl + 1, f.d, f.g, f.i // 3, sha256(string_agg(CASE WHEN t.i = f.i THEN f.x ELSE t.h END, '' ORDER BY t.i)),
         f.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> f.i), '')
  FROM {0} f JOIN {3} t ON t.lvl = f.lvl AND t.g = f.g AND t.i // 3 = f.i // 3
  WHERE EXISTS (SELECT 1 FROM {3} a WHERE a.lvl = f.lvl + 1 AND a.g = f.g)
  GROUP BY f.lvl, f.d, f.g, f.i, f.x, f.proof)"""

MERKLE = f"""WITH RECURSIVE docs AS (
  SELECT doc_id AS d, coalesce('s' || source, '') AS g, {_leaf('text')} AS h,
         CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
              ELSE {_leaf('text')} END AS x FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d NULLS FIRST, h) - 1 AS i FROM docs),
{_UP.format('tree', 'leaves')},
subroots AS (SELECT g, h FROM tree QUALIFY lvl = max(lvl) OVER (PARTITION BY g)),
heads AS (SELECT '' AS g, g AS s, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM subroots),
{_UP.format('upper', 'heads')},
root AS (SELECT h FROM upper ORDER BY lvl DESC LIMIT 1),
{_OVER.format('lower_path', "''", 'leaves', 'tree')},
half AS (SELECT p.d, s.g, s.i, p.x, p.proof, p.g AS s, s.h AS subroot
         FROM (SELECT * FROM lower_path QUALIFY lvl = max(lvl) OVER (PARTITION BY d)) p JOIN heads s ON s.s = p.g),
{_OVER.format('upper_path', 'proof', 'half', 'upper')},
whole AS (SELECT * FROM upper_path QUALIFY lvl = max(lvl) OVER (PARTITION BY d))
SELECT l.d AS doc_id, l.h AS leaf, m.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.x AS folded_root,
       w.x = r.h AS verified
FROM leaves l JOIN half m ON m.d = l.d JOIN whole w ON w.d = l.d CROSS JOIN root r"""

TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 20"""

ORACLE_SQL = {"op11_merkle": MERKLE, "op13_pivots": TOP_K}
