"""Raster path: PNGs written with zlib, read by Spark's image source, hashed by the numpy job."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from imprint.operators import raster as RA
from imprint.operators.registry import HASHING_METHODS
from imprint.operators.tables import first_by_key
from imprint.sources.images import png_bytes, read_images, split_valid


def _write(folder, rel, arr):
    path = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    c = 1 if arr.ndim == 2 else arr.shape[2]
    with open(path, "wb") as fh:
        fh.write(png_bytes(arr.tobytes(), arr.shape[1], arr.shape[0], c))
    return path


def test_read_modes_users_and_invalid(spark):
    root = tempfile.mkdtemp(prefix="imprint-png-")
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (20, 30), dtype=np.uint8)
    rgb = rng.integers(0, 256, (16, 12, 3), dtype=np.uint8)
    rgba = rng.integers(0, 256, (9, 9, 4), dtype=np.uint8)
    _write(root, "john.doe/g.png", grey)
    _write(root, "x/rgb.png", rgb)
    _write(root, "top.png", rgba)
    with open(os.path.join(root, "x", "broken.png"), "wb") as fh:
        fh.write(b"not an image")
    imgs = read_images(spark, root)
    rows = {os.path.basename(r["path"]): r for r in imgs.collect()}
    assert rows["g.png"]["user_name"] == "john"
    assert rows["rgb.png"]["user_name"] == "x"
    assert rows["top.png"]["user_name"] == "undefined"
    assert rows["g.png"]["image"]["nChannels"] == 1
    assert rows["rgb.png"]["image"]["nChannels"] == 3
    assert rows["top.png"]["image"]["nChannels"] == 4
    ok, bad = split_valid(imgs)
    assert [os.path.basename(r["path"]) for r in bad.collect()] == ["broken.png"]
    # bytes come back as BGR(A); to_rgb restores RGB(A)
    r = rows["rgb.png"]["image"]
    assert np.array_equal(RA.to_rgb(r["data"], r["height"], r["width"], 3), rgb)
    r = rows["top.png"]["image"]
    assert np.array_equal(RA.to_rgb(r["data"], r["height"], r["width"], 4), rgba)


def test_raster_hashes_match_grid_hashes_and_dedup(spark):
    root = tempfile.mkdtemp(prefix="imprint-png-")
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (40, 40), dtype=np.uint8)
    _write(root, "u1/a.png", img)
    _write(root, "u1/b.png", np.repeat(img[:, :, None], 3, axis=2))  # same grey, RGB mode
    _write(root, "u2/square.png", np.full((10, 10), 90, dtype=np.uint8))  # rotation = itself
    imgs = read_images(spark, root).withColumn("image_id", F.regexp_extract("path", r"/(\w+)\.png$", 1))
    rows = RA.raster_hashes(imgs, keys=("image_id",)).collect()
    by = {(r["image_id"], r["modification_id"], r["hashing_method_id"]): r for r in rows}
    for mid, meth in HASHING_METHODS.items():
        hid = list(HASHING_METHODS.ids().values())[[n for n, _ in HASHING_METHODS.items()].index(mid)]
        expect = format(meth.raster(img), "016x")
        assert by[("a", 1, hid)]["hash"] == expect == by[("b", 1, hid)]["hash"]
    # digest covers mode: grey and RGB copies of the same picture are different content
    assert by[("a", 1, 1)]["digest"] != by[("b", 1, 1)]["digest"]
    # uniform square: its rotation has the same content -> first writer keeps base only
    df = spark.createDataFrame(rows)
    kept = first_by_key(df.where("image_id = 'square'"), ["digest", "hashing_method_id"],
                        ["image_id", "modification_id"])
    assert sorted({r["modification_id"] for r in kept.collect()}) == [1]
    assert by[("square", 1, 1)]["hash"] == "ffffffffffffffff"


def test_stored_variant_pixels_rehash_to_the_same_fingerprints(spark):
    root = tempfile.mkdtemp(prefix="imprint-png-")
    rng = np.random.default_rng(9)
    _write(root, "u/a.png", rng.integers(0, 256, (21, 17), dtype=np.uint8))
    _write(root, "u/b.png", rng.integers(0, 256, (14, 30, 3), dtype=np.uint8))
    imgs = read_images(spark, root).withColumn("image_id", F.regexp_extract("path", r"/(\w+)\.png$", 1))
    imgs = imgs.withColumn("image_id", F.when(F.col("image_id") == "a", 1).otherwise(2).cast("long"))
    fused = {(r["image_id"], r["modification_id"], r["hashing_method_id"]): r["hash"]
             for r in RA.raster_hashes(imgs, keys=("image_id",)).collect()}
    variants = RA.raster_variants(imgs).withColumn(
        "modified_image_id", F.col("image_id") * 10 + F.col("modification_id"))
    again = {(r["modified_image_id"] // 10, r["modified_image_id"] % 10, r["hashing_method_id"]): r["hash"]
             for r in RA.raster_fingerprints(variants).collect()}
    assert again == fused and len(fused) == 8
