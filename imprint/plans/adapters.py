"""Adapters from the driver tables to the engine's data model.

* ``embeddings`` rows become 8x8 grey images: pixel = clip(floor((v+0.5)*255), 0, 255),
  user = ``'u' || label``.
* 16 consecutive ``embeddings`` rows tile a 32x32 image (4x4 tiles, row-major).
* ``pages.url`` is treated as a file path below ``scheme://``.
* ``events`` is split into an existing half and an incoming half by ``event_id``.

The image chain over the 8x8 images is the reference's dataflow expressed as
one plan: images -> every registered modification -> content digest -> first
writer per digest -> every registered hashing method -> fingerprints.
Ids are derived from keys (``image_id * n_mods + mod - 1``,
``modified_image_id * n_methods + method - 1``), so they are stable without a
global numbering step; the incremental job in :mod:`imprint.plans.chain` uses
serial ids instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.functions import grid as G
from imprint.operators import registry as R
from imprint.operators.tables import first_by_key
from imprint.session import spread

GRID_SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def grid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, user_name, px) — one 8x8 grey image per embedding row."""
    emb = spread(table(spark, sf_dir, "embeddings"))
    return emb.select(
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_name"),
        G.embedding_to_grid("embedding").alias("px"),
    )


def tiled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, px, width, height) — 32x32 grey images from 16 tiles each."""
    emb = table(spark, sf_dir, "embeddings")
    return G.tile_grids(emb.select("vec_id", G.embedding_to_grid("embedding").alias("px")), "vec_id", "px")


def grid_digest(px_col: str = "vpx") -> F.Column:
    """Content digest of a grey grid: sha256 over the pixel values and the mode name."""
    return F.sha2(F.concat(F.array_join(F.col(px_col), ","), F.lit(":L")), 256)


def variant_rows(spark: SparkSession, sf_dir: str, with_pixels: bool = False) -> DataFrame:
    """Every (image, modification) with digest, before the first-writer dedup."""
    n_mods = len(R.MODIFICATIONS.names())
    v = R.grid_variants(grid_images(spark, sf_dir), GRID_SIDE, GRID_SIDE)
    v = v.withColumn("modified_image_id", F.col("image_id") * n_mods + F.col("modification_id") - 1)
    v = v.withColumn("digest", grid_digest("vpx"))
    return v if with_pixels else v.drop("vpx")


def fingerprinted_variants(spark: SparkSession, sf_dir: str, engine: str = "arrow") -> DataFrame:
    """Variants with one hash column per method, computed in the same projection as the digest,
    so the dedup shuffle moves ids and strings only."""
    v = variant_rows(spark, sf_dir, with_pixels=True)
    sizes = {mod.size(GRID_SIDE, GRID_SIDE) for _, mod in R.MODIFICATIONS.items()}
    return R.grid_fingerprints(v, sizes, px_col="vpx", engine=engine)


def unique_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First writer (lowest image id, then modification order) per content digest."""
    v = variant_rows(spark, sf_dir)
    return first_by_key(v, ["digest"], ["image_id", "modification_id"])


def fingerprints(spark: SparkSession, sf_dir: str, engine: str = "arrow") -> DataFrame:
    """The ``hashes`` table of the 8x8 image chain:
    (id, hash, modified_image_id, hashing_method_id, image_id, modification_id, user_name)."""
    n_methods = len(R.HASHING_METHODS.names())
    fp = fingerprinted_variants(spark, sf_dir, engine)
    # first writer per digest; the order is the same for every method, so keying
    # on (digest, method) keeps the same variant for all of them in one shuffle
    kept = first_by_key(fp, ["digest", "hashing_method_id"], ["image_id", "modification_id"])
    return kept.select(
        (F.col("modified_image_id") * n_methods + F.col("hashing_method_id") - 1).alias("id"),
        "hash", "modified_image_id", "hashing_method_id", "image_id", "modification_id", "user_name",
    )
