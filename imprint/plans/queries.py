"""Registered queries: one per operator family of the blueprint, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full; the only limits are the keyset pages, whose page size *is* the feature.
Column names match :mod:`imprint.plans.oracle` exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.functions import grid as G
from imprint.functions import hashing as H
from imprint.functions.resample import resize_grid
from imprint.operators import analytics as AN
from imprint.functions.bits import hex_to_words, words_bit_count
from imprint.operators import match as M
from imprint.operators import multi_index as MI
from imprint.operators import nearest_k as NK
from imprint.operators import ordered as O
from imprint.operators import tables as TB
from imprint.operators.registry import (
    HASHING_METHODS, MODIFICATIONS, AverageHash, Base, Registry, batch_hash_udf, grid_variants, ragged_fingerprints,
)
from imprint.plans import adapters as A
from imprint.session import materialise, scratch_path
from imprint.sources import paths as P
from imprint.sources.keyed import KeyedTable

# Fixed parameters of the registered queries.
NEAR_BITS = 14  # near-duplicate threshold, in bits of 64 (banded: 15 bands)
PAGE_START, PAGE_SIZE = 100, 100  # keyset page of hashes (the reference pages by 100)
BACKLOG_START, BACKLOG_SIZE = 500, 10
LOOKUP_ID, LOOKUP_METHOD = 7, 2
NEAREST_K = 5
ORDERED_ROWS = 1000  # rows a file of the ordered layout
ODD_SIDE = 9
KEYED_ROWS, KEYED_LOTS = 500, 3  # rows a file, and appends, of the keyed table


def stored_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The ``hashes`` table, written once as Parquet to the shared folder.

    Like the stored table it stands for, it is read by the shape statistics and
    by the joins instead of being recomputed from the images by each of them.
    """
    return materialise(A.fingerprints(spark, sf), "hashes")


def q_average_hash(spark: SparkSession, sf: str) -> DataFrame:
    img = A.grid_images(spark, sf)
    return img.select("image_id", H.average_hash("px").alias("hash"))


def q_dct_hash(spark: SparkSession, sf: str) -> DataFrame:
    # dense 32x32 matrix work: the Arrow batch kernel (H.dct_hash is the same arithmetic as Columns)
    img = A.tiled_images(spark, sf)
    udf = batch_hash_udf(HASHING_METHODS.get("dct-hash"), 32, 32)
    return img.select("image_id", udf("px").alias("hash"))


def q_rotate_90(spark: SparkSession, sf: str) -> DataFrame:
    img = A.grid_images(spark, sf)
    rot = G.rotate90_ccw("px", F.lit(A.GRID_SIDE), F.lit(A.GRID_SIDE))
    return img.select("image_id", F.array_join(rot, ",").alias("pixels"))


def q_greyscale(spark: SparkSession, sf: str) -> DataFrame:
    emb = A.table(spark, sf, "embeddings")
    grey = G.greyscale_interleaved(G.embedding_to_grid("embedding"), 4)  # 64 values: 16 RGBA pixels
    return emb.select(F.col("vec_id"), F.array_join(grey, ",").alias("grey"))


def q_lanczos_resize(spark: SparkSession, sf: str) -> DataFrame:
    img = A.tiled_images(spark, sf)
    small = resize_grid("px", 32, 32, 8, 8)
    return img.select("image_id", F.array_join(small, ",").alias("pixels"))


def q_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = A.unique_variants(spark, sf)
    return v.select("modified_image_id", "image_id", "modification_id", "digest")


def q_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return A.fingerprints(spark, sf).select("id", "hash", "modified_image_id", "hashing_method_id")


def q_match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The shape for small tables (it raises beyond its bound)."""
    return M.match_pairs(stored_fingerprints(spark, sf), shape="broadcast")


def q_match_pairs_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The shape for tables of any size."""
    return M.match_pairs(stored_fingerprints(spark, sf), shape="blocks")


def q_histogram_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The left and right sides of block pairs joined, with the counts taken where they meet."""
    return AN.pair_histogram(stored_fingerprints(spark, sf), engine="join")


def q_near_duplicates_bands(spark: SparkSession, sf: str) -> DataFrame:
    return AN.near_duplicates(stored_fingerprints(spark, sf), NEAR_BITS, strategy="bands")


def q_nearest_bands(spark: SparkSession, sf: str) -> DataFrame:
    return AN.nearest_hash(stored_fingerprints(spark, sf), strategy="bands")


def q_nearest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The numpy kernel over block pairs."""
    return AN.nearest_hash(stored_fingerprints(spark, sf), engine="arrow")


def q_distance_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return AN.pair_histogram(stored_fingerprints(spark, sf))


def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return AN.threshold_sweep(AN.pair_histogram(stored_fingerprints(spark, sf)))


def q_variant_detection(spark: SparkSession, sf: str) -> DataFrame:
    return AN.variant_detection(stored_fingerprints(spark, sf), NEAR_BITS)


def q_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return AN.near_duplicates(stored_fingerprints(spark, sf), NEAR_BITS)


def q_nearest_hash(spark: SparkSession, sf: str) -> DataFrame:
    return AN.nearest_hash(stored_fingerprints(spark, sf))


def q_match_provenance(spark: SparkSession, sf: str) -> DataFrame:
    fp = stored_fingerprints(spark, sf)
    return AN.provenance(fp, MODIFICATIONS.frame(spark), HASHING_METHODS.frame(spark), shape="broadcast")


def q_content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents")
    rows = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
    return TB.first_by_key(rows, ["digest"], ["doc_id"])


def _activity(spark: SparkSession, sf: str):
    ev = A.table(spark, sf, "events")
    # the split point is one aggregate row; as a literal it also prunes the scan
    b = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    mid = (int(b["lo"]) + int(b["hi"])) // 2
    rows = ev.select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day"),
        (F.col("event_id") <= F.lit(mid)).alias("old"),
    )
    keys = ["user_id", "event_type", "day"]
    order = ["day", "user_id", "event_type"]
    old = rows.where("old").select(*keys).distinct()
    existing = TB.assign_ids(old, order, 0)
    incoming = rows.where(~F.col("old"))
    return existing, incoming, keys, order


def q_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    existing, incoming, keys, order = _activity(spark, sf)
    return TB.insert_or_ignore(existing, incoming.select(*keys), keys, order).select("id", *keys)


def q_keyed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """J7 on a table laid out by key: three appends, an insert of rows old and new, and its replay; the whole table."""
    existing, incoming, keys, order = _activity(spark, sf)
    table = KeyedTable(spark, scratch_path(spark, "keyed-activity"), existing.select("id", *keys).schema, keys,
                       rows_per_file=KEYED_ROWS, fanout=KEYED_LOTS)
    for lot in range(KEYED_LOTS):
        table.append(existing.where(F.col("id") % KEYED_LOTS == lot))
    incoming = materialise(incoming.select(*keys), "incoming")
    table.insert(incoming, keys, order)
    if table.insert(incoming, keys, order):
        raise RuntimeError("a replayed insert added rows")
    return table.read()


def q_get_or_create(spark: SparkSession, sf: str) -> DataFrame:
    existing, incoming, keys, order = _activity(spark, sf)
    with_id, _ = TB.get_or_create(existing, incoming.select("event_id", *keys), keys, "id", order)
    return with_id.select("event_id", F.col("id").alias("activity_id"))


def q_name_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation = A.table(spark, sf, "nation")
    region = A.table(spark, sf, "region")
    names = nation.select(F.col("n_name").alias("name")).union(region.select(F.col("r_name").alias("name")))
    out = TB.lookup_id(names, nation, "name", "n_name", "n_nationkey", "nation_id")
    out = TB.lookup_id(out, region, "name", "r_name", "r_regionkey", "region_id")
    return out.select("name", "nation_id", "region_id")


def q_user_from_path(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.table(spark, sf, "pages")
    return pages.select("page_id", P.user_from_url("url").alias("user_name"))


def q_hash_page(spark: SparkSession, sf: str) -> DataFrame:
    fp = stored_fingerprints(spark, sf)
    return TB.keyset_page(fp, PAGE_START, PAGE_SIZE, where=F.col("hashing_method_id") == 1).select("id", "hash")


def q_hash_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    fp = stored_fingerprints(spark, sf)
    return fp.where((F.col("hashing_method_id") == LOOKUP_METHOD) & (F.col("id") == LOOKUP_ID)).select("id", "hash")


def q_backlog_page(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents")
    return TB.keyset_page(docs, BACKLOG_START, BACKLOG_SIZE, id_col="doc_id").select("doc_id", "n_chars")


def q_next_id(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, col in (("documents", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey")):
        t = A.table(spark, sf, name)
        row = t.agg((TB.max_id(t, col) + 1).alias("next_id")).select(F.lit(name).alias("table_name"), "next_id")
        out = row if out is None else out.unionByName(row)
    return out


def q_fk_orphans(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: A.table(spark, sf, n) for n in ("labels", "documents", "lineitem", "orders", "part", "supplier",
                                            "customer")}
    checks = [
        ("labels.doc_id", t["labels"], "doc_id", t["documents"], "doc_id"),
        ("lineitem.l_orderkey", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        ("lineitem.l_partkey", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
        ("lineitem.l_suppkey", t["lineitem"], "l_suppkey", t["supplier"], "s_suppkey"),
        ("orders.o_custkey", t["orders"], "o_custkey", t["customer"], "c_custkey"),
    ]
    out = None
    for name, child, fk, parent, pk in checks:
        row = TB.orphans(child, fk, parent, pk).agg(F.count(F.lit(1)).alias("orphans")) \
            .select(F.lit(name).alias("relation"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def q_unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    checks = [
        ("documents.text", "documents", ["text"]),
        ("labels.doc_id", "labels", ["doc_id"]),
        ("orders.o_orderkey", "orders", ["o_orderkey"]),
        ("lineitem.l_orderkey_l_linenumber", "lineitem", ["l_orderkey", "l_linenumber"]),
        ("events.event_id", "events", ["event_id"]),
    ]
    out = None
    for name, tbl, keys in checks:
        rows = A.table(spark, sf, tbl).select(*keys)
        if keys == ["text"]:  # whole texts are compared by their digest, so none is shuffled
            rows = rows.select(F.sha2("text", 256).alias("text"))
        d = TB.duplicate_keys(rows, keys)
        row = d.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                    F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("duplicate_rows")) \
            .select(F.lit(name).alias("relation"), "duplicate_keys", "duplicate_rows")
        out = row if out is None else out.unionByName(row)
    return out


def q_stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    from imprint.streaming.ingest import ingest_documents

    return ingest_documents(spark, sf)


def q_image_scan(spark: SparkSession, sf: str) -> DataFrame:
    from imprint.plans.rasters import scan_derived_images

    return scan_derived_images(spark, sf)


def q_raster_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    from imprint.plans.rasters import fingerprint_derived_images

    return fingerprint_derived_images(spark, sf)


def q_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents")
    rows = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("digest"))
    return TB.losers_with_winner(rows, ["digest"], "doc_id", "first_doc_id").select("doc_id", "digest", "first_doc_id")


def q_sql_extraction(spark: SparkSession, sf: str) -> DataFrame:
    from imprint.plans.rasters import sql_extraction

    return sql_extraction(spark, sf)


def q_stored_chain(spark: SparkSession, sf: str) -> DataFrame:
    from imprint.plans.rasters import stored_chain_counts

    return stored_chain_counts(spark, sf)


def q_near_duplicates_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Four bands with probes inside block pairs: a few percent of the pairs are compared."""
    return MI.near_pairs(stored_fingerprints(spark, sf), NEAR_BITS)


def q_nearest_k(spark: SparkSession, sf: str) -> DataFrame:
    return NK.search(stored_fingerprints(spark, sf), NEAREST_K).neighbours


def q_id_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """P5, then from what it finds P6 (hash id by hash, variant and method) and P7 (variant id by its content path)."""
    fp = stored_fingerprints(spark, sf)
    variants = materialise(A.unique_variants(spark, sf).select(
        F.col("modified_image_id").alias("id"), P.content_path("/variants", F.col("digest")).alias("path")), "variants")
    found = TB.point_lookup(fp, ["hash", "modified_image_id"], id=LOOKUP_ID, hashing_method_id=LOOKUP_METHOD)
    one = TB.strict_single(found, f"hash {LOOKUP_ID}").first()
    hash_id = TB.point_lookup(fp, ["id"], hash=one["hash"], modified_image_id=one["modified_image_id"],
                              hashing_method_id=LOOKUP_METHOD)
    path = TB.point_lookup(variants, ["path"], id=one["modified_image_id"]).first()["path"]
    variant_id = TB.point_lookup(variants, ["id"], path=path)
    return hash_id.select(F.lit("hash_id").alias("lookup"), "id").unionByName(
        variant_id.select(F.lit("variant_id").alias("lookup"), "id"))


def _ordered(spark: SparkSession, sf: str) -> O.OrderedHashes:
    fp = stored_fingerprints(spark, sf).select("id", "hash", "modified_image_id", "hashing_method_id")
    return O.write_ordered(fp, scratch_path(spark, "ordered-hashes"), rows_per_file=ORDERED_ROWS)


def q_hash_walk(spark: SparkSession, sf: str) -> DataFrame:
    """S7 as a whole walk: the pages of every method with where they begin, end and resume."""
    pages = _ordered(spark, sf).pages(PAGE_SIZE)
    return pages.groupBy("hashing_method_id", "page").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("rows"),
        F.when(F.count(F.lit(1)) == PAGE_SIZE, F.max("id") + 1).alias("next_start"))


def q_method_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The methods that have hashes."""
    return TB.distinct_ids(stored_fingerprints(spark, sf).select(F.col("hashing_method_id").alias("id")))


def q_variants_capped(spark: SparkSession, sf: str) -> DataFrame:
    """L3: at most one variant an image, in registry order."""
    v = grid_variants(A.grid_images(spark, sf), A.GRID_SIDE, A.GRID_SIDE, limit=1)
    return v.select("image_id", "modification_id", A.grid_digest("vpx").alias("digest"))


class CropBorder:
    """A user's own modification: an eighth of each side goes, so its size follows from the image's."""

    def grid(self, px, w, h):
        dx, dy = F.floor(w / 8).cast("int"), F.floor(h / 8).cast("int")
        nw, nh = w - dx * 2, h - dy * 2
        crop = F.transform(F.sequence(F.lit(0), nw * nh - 1), lambda k: F.element_at(
            px, (F.floor(k / nw).cast("int") + dy) * w + k % nw + dx + 1))
        return crop, nw, nh

    def raster(self, arr):
        dy, dx = arr.shape[0] // 8, arr.shape[1] // 8
        return arr[dy:arr.shape[0] - dy, dx:arr.shape[1] - dx]


def q_crop_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """A registered modification of any size over images of unlike sizes, hashed by one kernel a size."""
    mods = Registry("modification")
    for name, cls in (("base", Base), ("crop_border", CropBorder)):
        mods.register(name)(cls)
    small = A.grid_images(spark, sf).select(F.lit("grid").alias("kind"), "image_id", "px", F.lit(A.GRID_SIDE).alias("width"),
                                            F.lit(A.GRID_SIDE).alias("height"))
    large = A.tiled_images(spark, sf).select(F.lit("tiled").alias("kind"), "image_id", "px", "width", "height")
    variants = grid_variants(small.unionByName(large), F.col("width"), F.col("height"), registry=mods).select(
        "kind", "image_id", "modification_id", "vwidth", "vheight", "vpx")
    methods = Registry("hashing method")
    methods.register("averagehash")(HASHING_METHODS.get("averagehash").__class__)
    return ragged_fingerprints(variants, methods=methods).drop("hashing_method_id")


def q_hash_9x9(spark: SparkSession, sf: str) -> DataFrame:
    """F5, F7, F12 with 81 bits, no multiple of 4: the hash, its rotation's, and their distance where they are as long."""
    udf = batch_hash_udf(AverageHash(ODD_SIDE), 32, 32)
    img = A.tiled_images(spark, sf).select("image_id", "px")
    rows = materialise(grid_variants(img, 32, 32).select("image_id", "modification_id", udf("vpx").alias("hash")), "hashes-9x9")
    both = rows.groupBy("image_id").agg(*[F.max(F.when(F.col("modification_id") == m, F.col("hash"))).alias(name)
                                          for m, name in ((1, "hash"), (2, "turned_hash"))])
    alike = F.length("hash") == F.length("turned_hash")
    return both.select("*", F.when(alike, words_bit_count(hex_to_words("hash"), hex_to_words("turned_hash"))).alias(
        "distance_bits"))


def _raster_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from imprint.plans import rasters

        return getattr(rasters, name)(spark, sf)
    return run


QUERIES = {
    "near_duplicates_multi": q_near_duplicates_multi,
    "nearest_k": q_nearest_k,
    "id_lookups": q_id_lookups,
    "hash_walk": q_hash_walk,
    "method_ids": q_method_ids,
    "variants_capped": q_variants_capped,
    "crop_fingerprints": q_crop_fingerprints,
    "hash_9x9": q_hash_9x9,
    "image_stream": _raster_query("image_stream"),
    "incremental_match": _raster_query("incremental_match"),
    "raster_sink": _raster_query("raster_sink"),
    "run_status": _raster_query("run_status"),
    "average_hash": q_average_hash,
    "dct_hash": q_dct_hash,
    "rotate_90": q_rotate_90,
    "greyscale": q_greyscale,
    "lanczos_resize": q_lanczos_resize,
    "variants": q_variants,
    "fingerprints": q_fingerprints,
    "match_pairs": q_match_pairs,
    "match_pairs_blocks": q_match_pairs_blocks,
    "histogram_blocks": q_histogram_blocks,
    "near_duplicates_bands": q_near_duplicates_bands,
    "nearest_bands": q_nearest_bands,
    "nearest_blocks": q_nearest_blocks,
    "distance_histogram": q_distance_histogram,
    "threshold_sweep": q_threshold_sweep,
    "variant_detection": q_variant_detection,
    "near_duplicates": q_near_duplicates,
    "nearest_hash": q_nearest_hash,
    "match_provenance": q_match_provenance,
    "content_dedup": q_content_dedup,
    "insert_or_ignore": q_insert_or_ignore,
    "get_or_create": q_get_or_create,
    "keyed_upsert": q_keyed_upsert,
    "name_lookup": q_name_lookup,
    "user_from_path": q_user_from_path,
    "hash_page": q_hash_page,
    "hash_point_lookup": q_hash_point_lookup,
    "backlog_page": q_backlog_page,
    "next_id": q_next_id,
    "fk_orphans": q_fk_orphans,
    "unique_violations": q_unique_violations,
    "stream_ingest": q_stream_ingest,
    "image_scan": q_image_scan,
    "raster_fingerprint": q_raster_fingerprint,
    "stored_chain": q_stored_chain,
    "exact_duplicates": q_exact_duplicates,
    "sql_extraction": q_sql_extraction,
}
