"""Raster queries over image files that Spark derives from the ``embeddings`` table.

Each 32x32 tiled image becomes a PNG under ``<folder>/u<label>/<image_id>.png``
(label of its first tile), grey for even ids and RGB (grey replicated) for odd
ones.  The files are written by the executors into a fresh folder of the
shared root; the queries then read them back through Spark's ``image`` source,
so the work grows with the table.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.operators.raster import bits_hex, content_digest, raster_hashes, to_grey
from imprint.operators.registry import HASHING_METHODS
from imprint.operators.tables import first_by_key
from imprint.plans import adapters as A
from imprint.session import materialise, scratch_path
from imprint.sources.images import png_bytes, read_images
from imprint.sources.paths import content_path


def write_derived_pngs(spark: SparkSession, sf_dir: str, root: str | None = None, where=None) -> str:
    """Write one PNG per tiled image (those that ``where`` keeps, by ``image_id``); returns the folder.

    The executors write through the file system that the folder's URI names; without ``root`` into a fresh folder.
    """
    root = root or scratch_path(spark, "derived-png")
    uri = f"file://{root}" if root.startswith("/") else root.replace("file:/", "file:///", 1) if re.match(
        "file:/[^/]", root) else root
    emb = A.table(spark, sf_dir, "embeddings")
    labels = emb.groupBy(F.expr("vec_id div 16").alias("image_id")).agg(F.min_by("label", "vec_id").alias("label"))
    img = A.tiled_images(spark, sf_dir).join(labels, "image_id")
    img = img.where(where) if where is not None else img

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            sizes = []
            for iid, label, px, w, h in zip(pdf.image_id, pdf.label, pdf.px, pdf.width, pdf.height):
                grey = np.asarray(px, dtype=np.uint8)
                ch = 1 if iid % 2 == 0 else 3
                data = grey if ch == 1 else np.repeat(grey, 3)
                folder = f"{base}/u{label}"
                fs.create_dir(folder)
                blob = png_bytes(data.tobytes(), int(w), int(h), ch)
                with fs.open_output_stream(f"{folder}/.{iid}.png.tmp") as out:
                    out.write(blob)
                fs.move(f"{folder}/.{iid}.png.tmp", f"{folder}/{iid}.png")  # retried tasks rewrite the same bytes
                sizes.append(len(blob))
            yield pd.DataFrame({"bytes": pd.Series(sizes, dtype="int64")})

    img.mapInPandas(write, "bytes long").agg(F.sum("bytes")).collect()
    return root


def _image_id(path_col: str = "path"):
    return F.regexp_extract(F.col(path_col), r"/(\d+)\.png$", 1).cast("bigint")


def scan_derived_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, user_name, height, width, n_channels) of every derived file."""
    root = write_derived_pngs(spark, sf_dir)
    imgs = read_images(spark, root)
    return imgs.select(
        _image_id().alias("image_id"), "user_name",
        F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
    )


def fingerprint_derived_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster chain: decode -> variants -> blake2b digest -> first writer -> Lanczos + hashes.

    One ``mapInPandas`` pass per image; the dedup shuffle moves only ids, digests and hashes.
    """
    root = write_derived_pngs(spark, sf_dir)
    imgs = read_images(spark, root)
    rows = raster_hashes(imgs.select(_image_id().alias("image_id"), "image"), keys=("image_id",))
    kept = first_by_key(rows, ["digest", "hashing_method_id"], ["image_id", "modification_id"])
    return kept.select("image_id", "modification_id", "hashing_method_id", "hash")


def run_stored_chain(spark: SparkSession, sf_dir: str):
    """Derive the files, then load, modify, hash and match them into a fresh store."""
    from imprint.plans.chain import ingest_folder, match_new
    from imprint.sources.store import Store

    root = write_derived_pngs(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"))
    ingest_folder(spark, store, root, "/variants")
    match_new(spark, store)
    return store


def stored_chain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stored job over the derived files: load, modify, hash, match; rows per table."""
    return table_counts(run_stored_chain(spark, sf_dir))


def table_counts(store) -> DataFrame:
    from imprint.sources.store import SCHEMAS

    out = None
    for name in SCHEMAS:
        row = store.read(name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


# What a user of the result tables writes — plain SQL over the seven tables.
DETECTION_SQL = """
SELECT h1.hashing_method_id,
       u1.name = u2.name AS same_user,
       CAST(round(m.hamming_distance * 64) AS INT) AS distance_bits,
       count(*) AS pairs
FROM matches m
JOIN hashes h1 ON m.hash_id1 = h1.id
JOIN hashes h2 ON m.hash_id2 = h2.id
JOIN modified_images v1 ON h1.modified_image_id = v1.id
JOIN modified_images v2 ON h2.modified_image_id = v2.id
JOIN images i1 ON v1.image_id = i1.id
JOIN images i2 ON v2.image_id = i2.id
JOIN users u1 ON i1.user_id = u1.id
JOIN users u2 ON i2.user_id = u2.id
WHERE m.hash_id1 <> m.hash_id2
GROUP BY h1.hashing_method_id, u1.name = u2.name, CAST(round(m.hamming_distance * 64) AS INT)
"""


def sql_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + D1: the stored chain, its tables as temp views, and one SQL text over them."""
    store = run_stored_chain(spark, sf_dir)
    store.views()
    return spark.sql(DETECTION_SQL)


def _middle(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(middle, number) of the image ids."""
    ids = A.table(spark, sf_dir, "embeddings").agg(
        F.min(F.expr("vec_id div 16")).alias("lo"), F.max(F.expr("vec_id div 16")).alias("hi"),
        F.countDistinct(F.expr("vec_id div 16")).alias("n")).first()
    return ((ids["lo"] or 0) + (ids["hi"] or 0)) // 2, ids["n"]


def image_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + S2 + T3: files arrive in two lots, a stream over the folder loads, modifies and hashes them, then match.

    Each lot is drained in bounded micro-batches; the second stream resumes the first one's checkpoint and sees
    the new files only; a third, with a checkpoint of its own, replays them all.  Rows per table, the number of
    micro-batches of the first two, and the rows that the replay added.
    """
    from imprint.plans.chain import ingest_stream, match_new
    from imprint.sources.store import Store

    middle, n = _middle(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "stream-store"))
    root, checkpoint = scratch_path(spark, "stream-png"), scratch_path(spark, "stream-checkpoint")

    def drain(at):
        q = ingest_stream(spark, store, root, "/variants", at, max_files=max(1, -(-n // 4)))
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))

    for lot in (F.col("image_id") <= middle, F.col("image_id") > middle):
        write_derived_pngs(spark, sf_dir, root, lot)
        drain(checkpoint)
    runs = store.log().status().where("stage = 'ingest' and state = 'done'")
    batches, hashes = runs.count(), store.read("hashes").count()
    drain(scratch_path(spark, "stream-replay"))
    match_new(spark, store)
    extra = spark.createDataFrame([("micro_batches", batches), ("replayed", store.read("hashes").count() - hashes)],
                                  "table_name string, rows long")
    return table_counts(store).unionByName(extra)


def incremental_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 + J7g: images arrive in two lots, each is matched, and a third match finds nothing new.

    Every stored pair as (method, image and modification of both sides, distance in bits), the lesser image first.
    """
    from imprint.plans.chain import ingest_folder, match_new
    from imprint.sources.store import Store

    middle, _ = _middle(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "incremental-store"))
    root = scratch_path(spark, "incremental-png")
    for lot in (F.col("image_id") <= middle, F.col("image_id") > middle):
        write_derived_pngs(spark, sf_dir, root, lot)
        ingest_folder(spark, store, root, "/variants")
        match_new(spark, store)
    if match_new(spark, store):
        raise RuntimeError("a rerun of the match added pairs")
    side = store.read("hashes").join(store.read("modified_images").select(
        F.col("id").alias("modified_image_id"), "image_id", "modification_id"), "modified_image_id").join(
        store.read("images").select(F.col("id").alias("image_id"), _image_id().alias("image")), "image_id").select(
        "id", "image", "modification_id")
    side = materialise(side, "incremental-sides")
    pairs = store.read("matches")
    for s in "12":
        pairs = pairs.join(side.select(F.col("id").alias(f"hash_id{s}"), F.struct("image", "modification_id").alias(f"s{s}")),
                           f"hash_id{s}")
    first, second = F.least("s1", "s2"), F.greatest("s1", "s2")
    return pairs.select("hashing_method_id", first["image"].alias("image_id1"), first["modification_id"].alias("modification1"),
                        second["image"].alias("image_id2"), second["modification_id"].alias("modification2"),
                        F.round(F.col("hamming_distance") * 64).cast("int").alias("distance_bits"))


def _check_raster(pixels):
    method = HASHING_METHODS.get("averagehash")
    return content_digest(pixels), bits_hex(method.raster(to_grey(pixels)), method.nbits), pixels.size


def raster_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + P9: the stored variant rasters, read back: size, channels, the hash of the stored pixels, and whether
    they are what their path's digest says."""
    from imprint.plans.chain import ingest_folder, map_rasters
    from imprint.sources.store import Store

    root = write_derived_pngs(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "raster-store"))
    ingest_folder(spark, store, root, "/variants", store_rasters=True)
    ingest_folder(spark, store, root, "/variants", store_rasters=True)  # a rerun adds none
    back = map_rasters(store, _check_raster, "digest string, hash string, n_bytes long")
    return back.select(_image_id("image_path").alias("image_id"), F.col("reg_id").alias("modification_id"), "height",
                       "width", "n_channels", "n_bytes", "hash",
                       (F.col("path") == content_path("/variants", F.col("digest"))).alias("path_is_content"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + A3 + F12: outcomes of match runs over the stored chain: new pairs, a rerun, and hashes of unlike lengths."""
    store = run_stored_chain(spark, sf_dir)
    from imprint.operators import match as M
    from imprint.plans.chain import match_new

    match_new(spark, store)
    cut = F.when(F.col("modified_image_id") % 2 == 0, F.col("hash")).otherwise(F.substring("hash", 1, 15))
    try:
        with store.log().run("match") as done:
            done(M.match_pairs(store.read("hashes").withColumn("hash", cut)).count())
    except Exception as e:  # noqa: BLE001 - the log has it; anything else is raised again
        if "Hashes must have the same length" not in str(e):
            raise
    status = store.log().status().groupBy("stage", "state", F.coalesce("counted", F.lit(0)).alias("counted"),
                                          F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("runs"))
    return status.withColumn("counted_so_far", F.lit(store.log().counted("match")).cast("long"))
