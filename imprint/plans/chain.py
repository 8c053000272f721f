"""The load -> modify -> hash -> match job over image files, idempotent and incremental.

``ingest_batch`` runs one batch of decoded images through every stage:

1. users (get-or-create by folder name) and images (insert-or-ignore on path);
2. one raster pass: every registered modification, its content digest and
   every registered hashing method (narrow output, pixels never shuffled);
3. first writer per digest, then insert-or-ignore of modified images on the
   content path ``<root>/<digest>.png`` and of hashes on
   (modified image, method, hash), each with serial ids;
4. undecodable files go to a quarantine output instead of failing a stage.

``match_new`` is the separate match step: hashes above the per-method
watermark (the largest id that a committed run covered) are paired with
every earlier hash and with each other, so a rerun adds only new pairs and a
run that was cut off, between stages or within one, is redone by the next.

``ingest_stream`` runs the same batch function as ``foreachBatch`` over a
file stream with ``maxFilesPerTrigger`` (bounded batches, checkpointed).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.operators import match as M
from imprint.operators.raster import from_bytes, raster_hashes, raster_pixels
from imprint.operators.registry import HASHING_METHODS, MODIFICATIONS
from imprint.operators.tables import first_by_key, lookup_id, new_rows
from imprint.session import materialise
from imprint.sources.images import read_images, split_valid, stream_images
from imprint.sources.paths import content_path
from imprint.sources.store import RASTERS, Store

PIXELS = "variant_pixels"  # pixels by batch; the index (RASTERS) makes them count


@dataclass
class BatchResult:
    images: int
    modified_images: int
    hashes: int
    quarantined: int


def _registry_map(spark: SparkSession, store: Store, registry, table: str, out: str) -> DataFrame:
    """registry id -> table id by name (a handful of rows, broadcast)."""
    reg = registry.frame(spark).select(F.col("id").alias("reg_id"), "name")
    return F.broadcast(reg.join(store.read(table), "name").select("reg_id", F.col("id").alias(out)))


def ingest_batch(spark: SparkSession, store: Store, images: DataFrame, variant_root: str,
                 store_rasters: bool = False) -> BatchResult:
    """One batch of ``(path, user_name, image)`` rows through load, modify and hash.

    The batch is decoded once: the raster pass emits narrow rows (path, user,
    modification, digest, method, hash) which are materialised, and every
    later step reads those.
    """
    from pyspark.sql import Observation

    store.init(MODIFICATIONS.names(), HASHING_METHODS.names())
    quarantined = Observation("quarantined")
    bad = F.sum(F.when(~F.col("valid"), 1).otherwise(0)).alias("bad")
    if store_rasters:
        pixels = uuid.uuid4().hex
        (raster_pixels(images, keys=("path", "user_name")).observe(quarantined, bad).write.mode("overwrite")
         .parquet(f"{store.path(PIXELS)}/batch={pixels}"))
        rows = _pixel_rows(spark, store, pixels).select(
            "path", "user_name", "valid", "modification_id", "digest", F.explode_outer("hashes").alias("h")).select(
            "*", "h.hashing_method_id", "h.hash").drop("h")
    else:
        rows = materialise(raster_hashes(images, keys=("path", "user_name"), keep_invalid=True), "batch-rows",
                           quarantined, bad)
    files = rows.select("path", "user_name").distinct()

    # load: users (get-or-create by name), then every file on its path, ids in path order.  Every step is
    # compared only with the files of its table that can hold the batch's keys (``store.near``).
    users = files.select(F.col("user_name").alias("name"))
    store.insert("users", users, ["name"], ["name"])
    with_uid = lookup_id(files, store.near("users", users), "user_name", "name", "id", "user_id", broadcast_dim=False)
    n_images = store.insert("images", with_uid.select("path", "user_id"), ["path"], ["path"])

    # modify + hash every decodable file of the batch, with the store's dimension ids.  Each
    # stage is insert-or-ignore against its table, so rows already stored are no-ops and a
    # batch interrupted between stages is completed by the next run (the tables, not the
    # rows a previous step happened to pass on, decide what is missing).
    batch_images = store.near("images", files).join(files.select("path"), "path", "left_semi") \
        .select(F.col("id").alias("image_id"), "path")
    mods = _registry_map(spark, store, MODIFICATIONS, "modifications", "mod_id")
    meths = _registry_map(spark, store, HASHING_METHODS, "hashing_methods", "method_id")
    ok = rows.where("valid").join(batch_images, "path")
    ok = ok.join(mods, ok.modification_id == F.col("reg_id")).drop("reg_id", "modification_id") \
        .withColumnRenamed("mod_id", "modification_id")
    ok = ok.join(meths, ok.hashing_method_id == F.col("reg_id")).drop("reg_id", "hashing_method_id") \
        .withColumnRenamed("method_id", "hashing_method_id")
    ok = ok.select("image_id", "modification_id", "hashing_method_id", "hash",
                   content_path(variant_root, F.col("digest")).alias("vpath"))

    # first writer per content path (W1), then insert-or-ignore against stored variants (J7d)
    variants = first_by_key(ok.select(F.col("vpath").alias("path"), "image_id", "modification_id").distinct(),
                            ["path"], ["image_id", "modification_id"])
    n_mod = store.insert("modified_images", variants, ["path"], ["image_id", "modification_id"])

    # hashes of the stored variants this batch's rows produced (J7f), serial ids; a variant
    # that lost its content path to another image matches no stored row and gets no hash
    stored = store.near("modified_images", variants).select(
        F.col("id").alias("modified_image_id"), F.col("path").alias("vpath"), "image_id", "modification_id")
    hashes = ok.join(stored, ["vpath", "image_id", "modification_id"]) \
        .select("hash", "modified_image_id", "hashing_method_id")
    keys = ["modified_image_id", "hashing_method_id", "hash"]
    n_hashes = store.insert("hashes", hashes, keys, keys)
    if store_rasters:
        index_rasters(store, pixels, batch_images, stored)
    return BatchResult(n_images, n_mod, n_hashes, int(quarantined.get.get("bad") or 0))


def _pixel_rows(spark: SparkSession, store: Store, batch: str) -> DataFrame:
    """What the decode pass of one batch wrote."""
    return spark.read.parquet(f"{store.path(PIXELS)}/batch={batch}")


def index_rasters(store: Store, batch: str, batch_images: DataFrame, stored: DataFrame) -> None:
    """S4, second phase: one index row per stored variant of the batch that has none yet.

    The decode pass wrote the pixels, in the files of its tasks, with everything else that it found out; which
    variant won its content path is settled on narrow rows.  A row of the index makes its pixels count; pixels
    without one (exact copies, a batch cut off before this) are never read.
    """
    spark = store.spark
    mods = _registry_map(spark, store, MODIFICATIONS, "modifications", "mod_id")
    made = _pixel_rows(spark, store, batch).where("valid").select(
        F.col("path").alias("image_path"), F.col("modification_id").alias("reg_id"), "height", "width", "n_channels")
    made = made.join(mods, "reg_id").join(batch_images.withColumnRenamed("path", "image_path"), "image_path")
    won = made.join(stored.select(F.col("vpath").alias("path"), "image_id", F.col("modification_id").alias("mod_id")),
                    ["image_id", "mod_id"])
    rows = won.select("path", F.lit(batch).alias("batch"), "image_path", "reg_id", "height", "width", "n_channels")
    rows = materialise(new_rows(rows, store.near(RASTERS, rows), ["path"]), "raster-index")
    store.append(RASTERS, rows)


def map_rasters(store: Store, run, schema: str) -> DataFrame:
    """``run(path of the image, modification, pixels) -> columns`` over all stored variants, with their index rows.

    The function runs where the pixels are read; only its narrow result meets the index.
    """
    spark = store.spark
    pixels = spark.read.parquet(store.path(PIXELS)).where("valid").select(
        "batch", F.col("path").alias("image_path"), F.col("modification_id").alias("reg_id"), "height", "width",
        "n_channels", "data")
    out = pixels.mapInPandas(_over_pixels(run, schema), f"batch string, image_path string, reg_id int, {schema}")
    return store.read(RASTERS).join(out, ["batch", "image_path", "reg_id"])


def _over_pixels(run, schema: str):
    names = [c.split()[0] for c in schema.split(",")]

    def whole(batches):
        for pdf in batches:
            done = [run(from_bytes(d, int(h), int(w), int(c)))
                    for h, w, c, d in zip(pdf.height, pdf.width, pdf.n_channels, pdf.data)]
            out = pdf[["batch", "image_path", "reg_id"]].copy()
            for i, name in enumerate(names):
                out[name] = [x[i] for x in done]
            yield out
    return whole


def quarantine(images: DataFrame) -> DataFrame:
    """Files the image source could not decode (``height = -1``)."""
    return split_valid(images)[1].select("path", "user_name")


def ingest_folder(spark: SparkSession, store: Store, image_root: str, variant_root: str,
                  store_rasters: bool = False) -> BatchResult:
    """Batch form: scan the whole folder once."""
    return ingest_batch(spark, store, read_images(spark, image_root), variant_root, store_rasters)


def ingest_stream(spark: SparkSession, store: Store, image_root: str, variant_root: str, checkpoint: str,
                  max_files: int = 10, available_now: bool = True, store_rasters: bool = False):
    """The same batch function over a bounded file stream; returns the started query.

    Every micro-batch leaves its outcome and its number of new hashes in the store's run log.
    """
    stream = stream_images(spark, image_root, max_files)

    def run(batch: DataFrame, epoch_id: int) -> None:
        with store.log().run("ingest", epoch_id) as done:
            done(ingest_batch(batch.sparkSession, store, batch, variant_root, store_rasters).hashes)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def match_new(spark: SparkSession, store: Store, **plan_kw) -> int:
    """T5 + J3 + J7g: pair every hash above its method's watermark with all hashes up to it and
    with each other (self-pairs included); return the number of new pairs (A3).

    The watermark is the store's commit manifest: the pairs are written first, replacing whatever a run that was
    cut off left behind the same watermark, and the manifest row makes them count.
    """
    with store.log().run("match") as done:
        n = _match_new(spark, store, **plan_kw)
        done(n)
    return n


def _match_new(spark: SparkSession, store: Store, **plan_kw) -> int:
    wm = store.match_watermarks()
    hashes = store.read("hashes").select("id", "hash", "hashing_method_id")
    marks = spark.createDataFrame([(m, w) for m, w in wm.items()] or [(-1, -1)], "hashing_method_id int, wm long")
    tagged = hashes.join(F.broadcast(marks), "hashing_method_id", "left") \
        .withColumn("is_new", F.col("id") > F.coalesce(F.col("wm"), F.lit(-1)))
    tagged = materialise(tagged.select("id", "hash", "hashing_method_id", "is_new"), "match-input")
    new = tagged.where("is_new").drop("is_new")
    old = tagged.where(~F.col("is_new")).drop("is_new")
    plan = M.plan_match(new, **plan_kw)
    upto = plan.max_ids
    if not upto:
        return 0
    counts = store.write_matches(M.match_pairs(new, plan=plan).unionByName(M.match_rectangle(new, old)), upto)
    store.commit_matches(upto, counts)
    return sum(counts.values())
