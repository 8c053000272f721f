"""DuckDB oracle SQL for every registered query (same column names and types).

The SQL is written independently of the Spark plans; only the fixed tables of
the definitions (resampling weights, DCT basis) are generated from the same
Python constants and spliced in as list literals.
"""

from __future__ import annotations

from imprint.functions.hashing import dct_basis
from imprint.functions.resample import PRECISION_BITS, padded
from imprint.plans.queries import (
    BACKLOG_SIZE, BACKLOG_START, LOOKUP_ID, LOOKUP_METHOD, NEAR_BITS, NEAREST_K, ODD_SIDE, PAGE_SIZE, PAGE_START,
)

PX = "CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.5) * 255), 0), 255) AS INTEGER)"


def _lst(values) -> str:
    return "[" + ",".join(str(int(v)) for v in values) + "]"


def rot_sql(p: str, n: int) -> str:
    return f"list_transform(range({n * n}), lambda k: {p}[(k % {n}) * {n} + ({n - 1} - k // {n}) + 1])"


def hex_sql(f: str) -> str:
    """64 booleans (MSB first) -> 16 lower-case hex digits."""
    nib = " + ".join(f"{w} * CAST({f}[4 * j + {i + 1}] AS INTEGER)" for i, w in enumerate((8, 4, 2, 1)))
    return f"array_to_string(list_transform(range(16), lambda j: substr('0123456789abcdef', 1 + {nib}, 1)), '')"


def hex_any_sql(f: str, n: int) -> str:
    """n booleans (MSB first) -> n // 4 hex digits, or one more if the bits beyond these are set."""
    pad = -n % 4
    bits = f"list_concat([{','.join(['false'] * pad)}], {f})" if pad else f
    nib = " + ".join(f"{w} * CAST(({bits})[4 * j + {i + 1}] AS INTEGER)" for i, w in enumerate((8, 4, 2, 1)))
    text = (f"array_to_string(list_transform(range({(n + pad) // 4}), "
            f"lambda j: substr('0123456789abcdef', 1 + {nib}, 1)), '')")
    return f"regexp_replace({text}, '^0', '')" if pad else text


def crop_sql(p: str, n: int) -> str:
    d, m = n // 8, n - 2 * (n // 8)
    return f"list_transform(range({m * m}), lambda k: {p}[(k // {m} + {d}) * {n} + k % {m} + {d} + 1])"


def avg_flags_sql(p: str) -> str:
    return f"list_transform({p}, lambda x: CAST(x AS BIGINT) * len({p}) >= list_sum({p}))"


def resize_pass_sql(p: str, n_lines: int, line_len: int, out_len: int, horizontal: bool) -> str:
    starts, weights, k = padded(line_len, out_len)
    s, w = _lst(starts), _lst(weights)
    if horizontal:
        line, o = f"(i // {out_len})", f"(i % {out_len})"
        idx = f"{line} * {line_len} + least({s}[{o} + 1] + t, {line_len - 1})"
    else:
        o, line = f"(i // {n_lines})", f"(i % {n_lines})"
        idx = f"least({s}[{o} + 1] + t, {line_len - 1}) * {n_lines} + {line}"
    acc = f"{1 << (PRECISION_BITS - 1)} + list_sum(list_transform(range({k}), lambda t: {w}[{o} * {k} + t + 1] * {p}[{idx} + 1]))"
    return (f"list_transform(range({n_lines * out_len}), lambda i: "
            f"CAST(least(greatest(({acc}) // {1 << PRECISION_BITS}, 0), 255) AS INTEGER))")


def dct_rows_sql(p: str) -> str:
    b = _lst(dct_basis())
    return (f"list_transform(range(256), lambda k: list_sum(list_transform(range(32), "
            f"lambda y: {b}[(k // 32) * 32 + y + 1] * CAST({p}[y * 32 + k % 32 + 1] AS BIGINT))))")


def dct_cols_sql(r: str) -> str:
    b = _lst(dct_basis())
    return (f"list_transform(range(64), lambda k: list_sum(list_transform(range(32), "
            f"lambda x: {r}[(k // 8) * 32 + x + 1] * {b}[(k % 8) * 32 + x + 1])))")


def median_flags_sql(d: str) -> str:
    return (f"list_transform({d}, lambda c: 2 * c > list_sort({d})[(len({d}) + 1) // 2] "
            f"+ list_sort({d})[len({d}) // 2 + 1])")


IMAGES = f"""images AS (
  SELECT vec_id AS image_id, 'u' || CAST(label AS VARCHAR) AS user_name,
         list_transform(embedding, lambda v: {PX}) AS px
  FROM embeddings)"""

TILED = f"""tiles AS (
  SELECT vec_id // 16 AS image_id, vec_id % 16 AS t, list_transform(embedding, lambda v: {PX}) AS px
  FROM embeddings),
tl AS (
  SELECT g.image_id, list(coalesce(p.px, list_transform(range(64), lambda k: 0)) ORDER BY g.t) AS tl
  FROM (SELECT DISTINCT i.image_id, s.t FROM tiles i, range(16) s(t)) g
  LEFT JOIN tiles p ON p.image_id = g.image_id AND p.t = g.t GROUP BY g.image_id),
tiled AS (
  SELECT image_id, list_transform(range(1024), lambda k:
    tl[((k // 32) // 8) * 4 + (k % 32) // 8 + 1][((k // 32) % 8) * 8 + (k % 32) % 8 + 1]) AS px
  FROM tl)"""

VARIANTS = f"""variants AS (
  SELECT image_id, user_name, 1 AS modification_id, px AS vpx FROM images
  UNION ALL
  SELECT image_id, user_name, 2 AS modification_id, {rot_sql('px', 8)} AS vpx FROM images),
vrows AS (
  SELECT *, image_id * 2 + modification_id - 1 AS modified_image_id,
         sha256(array_to_string(vpx, ',') || ':L') AS digest
  FROM variants),
uvar AS (
  SELECT * FROM vrows
  QUALIFY row_number() OVER (PARTITION BY digest ORDER BY image_id, modification_id) = 1)"""

FINGERPRINTS = f"""{IMAGES},
{VARIANTS},
up AS (SELECT *, {resize_pass_sql('vpx', 8, 8, 32, True)} AS h32 FROM uvar),
up2 AS (SELECT *, {resize_pass_sql('h32', 32, 8, 32, False)} AS p32 FROM up),
r AS (SELECT *, {dct_rows_sql('p32')} AS rr FROM up2),
d AS (SELECT *, {dct_cols_sql('rr')} AS dd FROM r),
fl AS (
  SELECT modified_image_id, image_id, modification_id, user_name, 1 AS hashing_method_id,
         {avg_flags_sql('vpx')} AS f FROM uvar
  UNION ALL
  SELECT modified_image_id, image_id, modification_id, user_name, 2 AS hashing_method_id,
         {median_flags_sql('dd')} AS f FROM d),
fp AS (
  SELECT modified_image_id * 2 + hashing_method_id - 1 AS id, {hex_sql('f')} AS hash,
         modified_image_id, hashing_method_id, image_id, modification_id, user_name
  FROM fl)"""

DIST = "bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT))"

PAIRS = f"""pairs AS (
  SELECT a.id AS hash_id1, b.id AS hash_id2, {DIST} / 64.0 AS hamming_distance,
         a.hashing_method_id, a.image_id AS image_id1, b.image_id AS image_id2,
         CAST({DIST} AS INTEGER) AS bits
  FROM fp a JOIN fp b ON a.hashing_method_id = b.hashing_method_id AND a.id <= b.id)"""

HIST = f"""{PAIRS},
hist AS (
  SELECT hashing_method_id, image_id1 = image_id2 AS same_image, bits AS distance_bits, count(*) AS pairs
  FROM pairs WHERE hash_id1 <> hash_id2 GROUP BY ALL)"""

NEAR = f"""near AS (
  SELECT hash_id1, hash_id2, hamming_distance, hashing_method_id FROM pairs
  WHERE hash_id1 < hash_id2 AND bits <= {NEAR_BITS})"""

ACTIVITY = """ev AS (
  SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day,
         event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events) AS old
  FROM events),
existing AS (
  SELECT row_number() OVER (ORDER BY day, user_id, event_type) AS id, user_id, event_type, day
  FROM (SELECT DISTINCT user_id, event_type, day FROM ev WHERE old)),
incoming AS (SELECT DISTINCT user_id, event_type, day FROM ev WHERE NOT old),
created AS (
  SELECT (SELECT coalesce(max(id), 0) FROM existing) + row_number() OVER (ORDER BY day, user_id, event_type) AS id,
         user_id, event_type, day
  FROM incoming i
  WHERE NOT EXISTS (SELECT 1 FROM existing e
                    WHERE e.user_id = i.user_id AND e.event_type = i.event_type AND e.day = i.day))"""

CONTENT_DEDUP = """SELECT doc_id, digest FROM (SELECT doc_id, sha256(text) AS digest FROM documents)
QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1"""

USER_FROM_URL = r"""SELECT page_id,
  CASE WHEN len(parts) <= 1 THEN 'undefined' ELSE regexp_replace(parts[-2], '^(.+)\.[^.]+$', '\1') END AS user_name
FROM (
  SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/+', '/', 'g'), '/$', ''), '/') AS parts
  FROM pages)"""

RASTER = f"""{TILED},
lab AS (SELECT vec_id // 16 AS image_id, label FROM embeddings WHERE vec_id % 16 = 0),
files AS (SELECT t.image_id, 'u' || CAST(l.label AS VARCHAR) AS user_name, t.px,
                 CASE WHEN t.image_id % 2 = 0 THEN 1 ELSE 3 END AS n_channels
          FROM tiled t JOIN lab l USING (image_id)),
rv AS (
  SELECT image_id, n_channels, 1 AS modification_id, px AS vpx FROM files
  UNION ALL
  SELECT image_id, n_channels, 2 AS modification_id, {rot_sql('px', 32)} AS vpx FROM files),
ru AS (
  SELECT * FROM rv
  QUALIFY row_number() OVER (PARTITION BY array_to_string(vpx, ','), n_channels
                             ORDER BY image_id, modification_id) = 1),
rh AS (SELECT *, {resize_pass_sql('vpx', 32, 32, 8, True)} AS h8 FROM ru),
rs AS (SELECT *, {resize_pass_sql('h8', 8, 32, 8, False)} AS p8 FROM rh),
rr AS (SELECT *, {dct_rows_sql('vpx')} AS rr FROM ru),
rd AS (SELECT *, {dct_cols_sql('rr')} AS dd FROM rr),
rf AS (
  SELECT image_id, modification_id, 1 AS hashing_method_id, {avg_flags_sql('p8')} AS f FROM rs
  UNION ALL
  SELECT image_id, modification_id, 2 AS hashing_method_id, {median_flags_sql('dd')} AS f FROM rd)"""


def oracle_sql() -> dict[str, str]:
    dct_sql = f"""WITH {TILED},
r AS (SELECT image_id, {dct_rows_sql('px')} AS rr FROM tiled),
d AS (SELECT image_id, {dct_cols_sql('rr')} AS dd FROM r),
f AS (SELECT image_id, {median_flags_sql('dd')} AS f FROM d)
SELECT image_id, {hex_sql('f')} AS hash FROM f"""
    sql = {
        "average_hash": f"""WITH {IMAGES}, f AS (SELECT image_id, {avg_flags_sql('px')} AS f FROM images)
SELECT image_id, {hex_sql('f')} AS hash FROM f""",
        "dct_hash": dct_sql,
        "rotate_90": f"WITH {IMAGES} SELECT image_id, array_to_string({rot_sql('px', 8)}, ',') AS pixels FROM images",
        "greyscale": f"""SELECT vec_id, array_to_string(list_transform(range(len(px) // 4), lambda k:
    (px[4 * k + 1] * 19595 + px[4 * k + 2] * 38470 + px[4 * k + 3] * 7471 + 32768) >> 16), ',') AS grey
FROM (SELECT vec_id, list_transform(embedding, lambda v: {PX}) AS px FROM embeddings)""",
        "lanczos_resize": f"""WITH {TILED},
h AS (SELECT image_id, {resize_pass_sql('px', 32, 32, 8, True)} AS h8 FROM tiled),
v AS (SELECT image_id, {resize_pass_sql('h8', 8, 32, 8, False)} AS p8 FROM h)
SELECT image_id, array_to_string(p8, ',') AS pixels FROM v""",
        "variants": f"WITH {IMAGES}, {VARIANTS} SELECT modified_image_id, image_id, modification_id, digest FROM uvar",
        "fingerprints": f"WITH {FINGERPRINTS} SELECT id, hash, modified_image_id, hashing_method_id FROM fp",
        "match_pairs": f"""WITH {FINGERPRINTS}, {PAIRS}
SELECT hash_id1, hash_id2, hamming_distance, hashing_method_id FROM pairs""",
        "distance_histogram": f"WITH {FINGERPRINTS}, {HIST} SELECT * FROM hist",
        "threshold_sweep": f"""WITH {FINGERPRINTS}, {HIST},
totals AS (
  SELECT hashing_method_id,
         CAST(sum(CASE WHEN same_image THEN pairs ELSE 0 END) AS BIGINT) AS positives,
         CAST(sum(CASE WHEN NOT same_image THEN pairs ELSE 0 END) AS BIGINT) AS negatives
  FROM hist GROUP BY hashing_method_id),
grid AS (SELECT t.*, CAST(g.range AS INTEGER) AS threshold_bits FROM totals t, range(65) g),
acc AS (
  SELECT g.hashing_method_id, g.threshold_bits,
         CAST(coalesce(sum(CASE WHEN h.same_image THEN h.pairs END), 0) AS BIGINT) AS true_accepts,
         CAST(coalesce(sum(CASE WHEN NOT h.same_image THEN h.pairs END), 0) AS BIGINT) AS false_accepts,
         g.positives, g.negatives
  FROM grid g LEFT JOIN hist h ON h.hashing_method_id = g.hashing_method_id AND h.distance_bits <= g.threshold_bits
  GROUP BY g.hashing_method_id, g.threshold_bits, g.positives, g.negatives)
SELECT *, positives - true_accepts AS false_rejects, negatives - false_accepts AS true_rejects,
       CASE WHEN positives > 0 THEN CAST(true_accepts AS DOUBLE) / positives END AS true_accept_rate,
       CASE WHEN negatives > 0 THEN CAST(false_accepts AS DOUBLE) / negatives END AS false_accept_rate
FROM acc""",
        "variant_detection": f"""WITH {FINGERPRINTS}
SELECT v.hashing_method_id, v.modification_id, count(*) AS images,
       CAST(sum(CASE WHEN {DIST.replace('a.', 'v.').replace('b.', 'b0.')} <= {NEAR_BITS} THEN 1 ELSE 0 END) AS BIGINT) AS detected,
       CAST(sum({DIST.replace('a.', 'v.').replace('b.', 'b0.')}) AS BIGINT) AS sum_bits
FROM fp v JOIN fp b0 ON v.image_id = b0.image_id AND v.hashing_method_id = b0.hashing_method_id
WHERE b0.modification_id = 1 AND v.modification_id <> 1
GROUP BY v.hashing_method_id, v.modification_id""",
        "near_duplicates": f"WITH {FINGERPRINTS}, {PAIRS}, {NEAR} SELECT * FROM near",
        "nearest_hash": f"""WITH {FINGERPRINTS}, {PAIRS},
both_dirs AS (
  SELECT hash_id1 AS hash_id, hash_id2 AS nearest_id, bits AS distance_bits FROM pairs WHERE hash_id1 < hash_id2
  UNION ALL
  SELECT hash_id2, hash_id1, bits FROM pairs WHERE hash_id1 < hash_id2)
SELECT hash_id, nearest_id, distance_bits FROM both_dirs
QUALIFY row_number() OVER (PARTITION BY hash_id ORDER BY distance_bits, nearest_id) = 1""",
        "match_provenance": f"""WITH {FINGERPRINTS}, {PAIRS},
mods AS (SELECT * FROM (VALUES (1, 'base'), (2, 'rotate_90')) m(id, name)),
meths AS (SELECT * FROM (VALUES (1, 'averagehash'), (2, 'dct-hash')) m(id, name))
SELECT n.hash_id1, n.hash_id2, n.hamming_distance, me.name AS method_name,
       f1.image_id AS image_id1, f2.image_id AS image_id2, f1.user_name AS user1, f2.user_name AS user2,
       m1.name AS modification1, m2.name AS modification2
FROM pairs n JOIN fp f1 ON n.hash_id1 = f1.id JOIN fp f2 ON n.hash_id2 = f2.id
JOIN mods m1 ON f1.modification_id = m1.id JOIN mods m2 ON f2.modification_id = m2.id
JOIN meths me ON n.hashing_method_id = me.id""",
        "content_dedup": CONTENT_DEDUP,
        "insert_or_ignore": f"WITH {ACTIVITY} SELECT id, user_id, event_type, day FROM created",
        "keyed_upsert": f"""WITH {ACTIVITY}
SELECT id, user_id, event_type, day FROM existing UNION ALL SELECT id, user_id, event_type, day FROM created""",
        "get_or_create": f"""WITH {ACTIVITY},
dim AS (SELECT id, user_id, event_type, day FROM existing UNION ALL SELECT id, user_id, event_type, day FROM created)
SELECT e.event_id, d.id AS activity_id
FROM ev e JOIN dim d ON e.user_id = d.user_id AND e.event_type = d.event_type AND e.day = d.day
WHERE NOT e.old""",
        "name_lookup": """WITH names AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)
SELECT x.name, n.n_nationkey AS nation_id, r.r_regionkey AS region_id
FROM names x LEFT JOIN nation n ON x.name = n.n_name LEFT JOIN region r ON x.name = r.r_name""",
        "user_from_path": USER_FROM_URL,
        "hash_page": f"""WITH {FINGERPRINTS}
SELECT id, hash FROM fp WHERE id >= {PAGE_START} AND hashing_method_id = 1 ORDER BY id LIMIT {PAGE_SIZE}""",
        "hash_point_lookup": f"""WITH {FINGERPRINTS}
SELECT id, hash FROM fp WHERE hashing_method_id = {LOOKUP_METHOD} AND id = {LOOKUP_ID}""",
        "backlog_page": f"""SELECT doc_id, n_chars FROM documents WHERE doc_id >= {BACKLOG_START}
ORDER BY doc_id LIMIT {BACKLOG_SIZE}""",
        "next_id": """SELECT 'documents' AS table_name, CAST(coalesce(max(doc_id), 0) AS BIGINT) + 1 AS next_id FROM documents
UNION ALL SELECT 'events', CAST(coalesce(max(event_id), 0) AS BIGINT) + 1 FROM events
UNION ALL SELECT 'orders', CAST(coalesce(max(o_orderkey), 0) AS BIGINT) + 1 FROM orders""",
        "fk_orphans": """SELECT 'labels.doc_id' AS relation, count(*) AS orphans FROM labels
  WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL)
UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem
  WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)
UNION ALL SELECT 'lineitem.l_suppkey', count(*) FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey IS NOT NULL)
UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders
  WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)""",
        "unique_violations": """WITH d AS (
  SELECT 'documents.text' AS relation, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1
  UNION ALL SELECT 'labels.doc_id', count(*) FROM labels GROUP BY doc_id HAVING count(*) > 1
  UNION ALL SELECT 'orders.o_orderkey', count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1
  UNION ALL SELECT 'lineitem.l_orderkey_l_linenumber', count(*) FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
  UNION ALL SELECT 'events.event_id', count(*) FROM events GROUP BY event_id HAVING count(*) > 1),
r AS (SELECT * FROM (VALUES ('documents.text'), ('labels.doc_id'), ('orders.o_orderkey'),
                            ('lineitem.l_orderkey_l_linenumber'), ('events.event_id')) v(relation))
SELECT r.relation, count(d.rows) AS duplicate_keys, CAST(coalesce(sum(d.rows), 0) AS BIGINT) AS duplicate_rows
FROM r LEFT JOIN d USING (relation) GROUP BY r.relation""",
        "stream_ingest": CONTENT_DEDUP,
        "image_scan": f"""WITH {TILED},
lab AS (SELECT vec_id // 16 AS image_id, label FROM embeddings WHERE vec_id % 16 = 0)
SELECT t.image_id, 'u' || CAST(l.label AS VARCHAR) AS user_name, 32 AS height, 32 AS width,
       CASE WHEN t.image_id % 2 = 0 THEN 1 ELSE 3 END AS n_channels
FROM tiled t JOIN lab l USING (image_id)""",
        "raster_fingerprint": f"""WITH {RASTER}
SELECT image_id, modification_id, hashing_method_id, {hex_sql('f')} AS hash FROM rf""",
        "exact_duplicates": """WITH d AS (SELECT doc_id, sha256(text) AS digest FROM documents)
SELECT d.doc_id, d.digest, w.first_doc_id
FROM d JOIN (SELECT digest, min(doc_id) AS first_doc_id FROM d GROUP BY digest) w USING (digest)
WHERE d.doc_id <> w.first_doc_id""",
        "sql_extraction": f"""WITH {RASTER},
rfp AS (SELECT r.image_id, r.modification_id, r.hashing_method_id, f.user_name, {hex_sql('r.f')} AS hash
        FROM rf r JOIN files f USING (image_id))
SELECT a.hashing_method_id, a.user_name = b.user_name AS same_user,
       CAST(bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) AS INTEGER) AS distance_bits,
       count(*) AS pairs
FROM rfp a JOIN rfp b ON a.hashing_method_id = b.hashing_method_id
 AND (a.image_id < b.image_id OR (a.image_id = b.image_id AND a.modification_id < b.modification_id))
GROUP BY ALL""",
        "stored_chain": f"""WITH {RASTER},
n AS (SELECT (SELECT count(*) FROM files) AS images, (SELECT count(*) FROM ru) AS variants,
             (SELECT count(DISTINCT user_name) FROM files) AS users)
SELECT 'modifications' AS table_name, CAST(2 AS BIGINT) AS rows
UNION ALL SELECT 'hashing_methods', 2
UNION ALL SELECT 'users', users + 1 FROM n
UNION ALL SELECT 'images', images FROM n
UNION ALL SELECT 'modified_images', variants FROM n
UNION ALL SELECT 'hashes', 2 * variants FROM n
UNION ALL SELECT 'matches', variants * (variants + 1) FROM n""",
    }
    sql |= {
        "nearest_k": f"""WITH {FINGERPRINTS}, {PAIRS},
both_dirs AS (
  SELECT hash_id1 AS hash_id, hash_id2 AS neighbour_id, bits AS distance_bits FROM pairs WHERE hash_id1 < hash_id2
  UNION ALL
  SELECT hash_id2, hash_id1, bits FROM pairs WHERE hash_id1 < hash_id2)
SELECT hash_id, CAST(row_number() OVER (PARTITION BY hash_id ORDER BY distance_bits, neighbour_id) AS INTEGER) AS rank,
       neighbour_id, distance_bits FROM both_dirs QUALIFY rank <= {NEAREST_K}""",
        "id_lookups": f"""WITH {FINGERPRINTS},
one AS (SELECT * FROM fp WHERE id = {LOOKUP_ID} AND hashing_method_id = {LOOKUP_METHOD})
SELECT 'hash_id' AS lookup, f.id FROM fp f JOIN one o ON f.hash = o.hash AND f.modified_image_id = o.modified_image_id
   AND f.hashing_method_id = o.hashing_method_id
UNION ALL SELECT 'variant_id', u.modified_image_id FROM uvar u WHERE '/variants/' || digest || '.png' =
  (SELECT '/variants/' || w.digest || '.png' FROM uvar w JOIN one USING (modified_image_id))""",
        "hash_walk": f"""WITH {FINGERPRINTS},
p AS (SELECT *, CAST((row_number() OVER (PARTITION BY hashing_method_id ORDER BY id) - 1) // {PAGE_SIZE} AS INTEGER) AS page
      FROM fp)
SELECT hashing_method_id, page, min(id) AS first_id, max(id) AS last_id, count(*) AS rows,
       CASE WHEN count(*) = {PAGE_SIZE} THEN max(id) + 1 END AS next_start FROM p GROUP BY ALL""",
        "method_ids": f"WITH {FINGERPRINTS} SELECT DISTINCT hashing_method_id AS id FROM fp",
        "variants_capped": f"""WITH {IMAGES}
SELECT image_id, 1 AS modification_id, sha256(array_to_string(px, ',') || ':L') AS digest FROM images""",
        "crop_fingerprints": f"""WITH {IMAGES}, {TILED},
v AS (
  SELECT 'grid' AS kind, image_id, 1 AS modification_id, 8 AS vwidth, px AS p8 FROM images
  UNION ALL SELECT 'grid', image_id, 2, 6, {resize_pass_sql('c6', 8, 6, 8, False)}
  FROM (SELECT image_id, {resize_pass_sql(crop_sql('px', 8), 6, 6, 8, True)} AS c6 FROM images)
  UNION ALL SELECT 'tiled', image_id, 1, 32, {resize_pass_sql('c32', 8, 32, 8, False)}
  FROM (SELECT image_id, {resize_pass_sql('px', 32, 32, 8, True)} AS c32 FROM tiled)
  UNION ALL SELECT 'tiled', image_id, 2, 24, {resize_pass_sql('c24', 8, 24, 8, False)}
  FROM (SELECT image_id, {resize_pass_sql('c', 24, 24, 8, True)} AS c24
        FROM (SELECT image_id, {crop_sql('px', 32)} AS c FROM tiled))),
f AS (SELECT *, {avg_flags_sql('p8')} AS f FROM v)
SELECT kind, image_id, modification_id, vwidth, vwidth AS vheight, {hex_sql('f')} AS hash FROM f""",
        "hash_9x9": f"""WITH {TILED},
v AS (SELECT image_id, px, {rot_sql('px', 32)} AS turned FROM tiled),
h AS (SELECT image_id, {resize_pass_sql('px', 32, 32, ODD_SIDE, True)} AS a,
             {resize_pass_sql('turned', 32, 32, ODD_SIDE, True)} AS b FROM v),
r AS (SELECT image_id, {resize_pass_sql('a', ODD_SIDE, 32, ODD_SIDE, False)} AS a,
             {resize_pass_sql('b', ODD_SIDE, 32, ODD_SIDE, False)} AS b FROM h),
f AS (SELECT image_id, {avg_flags_sql('a')} AS fa, {avg_flags_sql('b')} AS fb FROM r),
x AS (SELECT image_id, {hex_any_sql('fa', ODD_SIDE**2)} AS hash, {hex_any_sql('fb', ODD_SIDE**2)} AS turned_hash, fa, fb
      FROM f)
SELECT image_id, hash, turned_hash, CASE WHEN len(hash) = len(turned_hash) THEN CAST(list_sum(list_transform(
  range({ODD_SIDE**2}), lambda i: CAST(fa[i + 1] <> fb[i + 1] AS INTEGER))) AS INTEGER) END AS distance_bits FROM x""",
        "image_stream": f"""{sql['stored_chain']}
UNION ALL SELECT 'micro_batches', (SELECT sum((c + m - 1) // m) FROM (
    SELECT count(*) AS c, any_value((t.n + 3) // 4) AS m FROM files f, (SELECT count(*) AS n, (min(image_id) + max(image_id)) // 2
      AS mid FROM files) t GROUP BY f.image_id <= t.mid))
UNION ALL SELECT 'replayed', 0""",
        "incremental_match": f"""WITH {RASTER},
rfp AS (SELECT image_id, modification_id, hashing_method_id, {hex_sql('f')} AS hash FROM rf)
SELECT a.hashing_method_id, a.image_id AS image_id1, a.modification_id AS modification1, b.image_id AS image_id2,
       b.modification_id AS modification2,
       CAST(bit_count(xor(('0x' || a.hash)::UBIGINT, ('0x' || b.hash)::UBIGINT)) AS INTEGER) AS distance_bits
FROM rfp a JOIN rfp b ON a.hashing_method_id = b.hashing_method_id
 AND (a.image_id < b.image_id OR (a.image_id = b.image_id AND a.modification_id <= b.modification_id))""",
        "raster_sink": f"""WITH {RASTER}
SELECT u.image_id, u.modification_id, 32 AS height, 32 AS width, u.n_channels, CAST(1024 * u.n_channels AS BIGINT) AS n_bytes,
       {hex_sql('r.f')} AS hash, true AS path_is_content
FROM ru u JOIN rf r ON r.image_id = u.image_id AND r.modification_id = u.modification_id AND r.hashing_method_id = 1""",
        "run_status": f"""WITH {RASTER}, n AS (SELECT CAST(count(*) * (count(*) + 1) AS BIGINT) AS pairs FROM ru)
SELECT 'match' AS stage, 'done' AS state, pairs AS counted, '' AS error, CAST(1 AS BIGINT) AS runs, pairs AS counted_so_far
FROM n
UNION ALL SELECT 'match', 'done', 0, '', 1, pairs FROM n
UNION ALL SELECT 'match', 'failed', 0, 'Hashes must have the same length', 1, pairs FROM n""",
    }
    # the same results by the routes meant for large tables
    same = {"near_duplicates_multi": "near_duplicates", "match_pairs_blocks": "match_pairs", "histogram_blocks": "distance_histogram",
            "near_duplicates_bands": "near_duplicates", "nearest_bands": "nearest_hash", "nearest_blocks": "nearest_hash"}
    return sql | {route: sql[plain] for route, plain in same.items()}
