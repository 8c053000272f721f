"""Smaller surface of the inventory: missing root, raster sink, point lookups, caps, registration."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.functions import grid as G
from imprint.operators import registry as R
from imprint.operators import tables as TB
from imprint.plans import chain as C
from imprint.session import scratch_path
from imprint.sources.images import png_bytes, read_images
from imprint.sources.store import Store


def test_missing_root_raises(spark):
    with pytest.raises(ValueError, match="does not exist"):
        read_images(spark, "/nonexistent/imprint/root")


def test_raster_sink_keeps_inserted_variants(spark):
    src = tempfile.mkdtemp(prefix="imprint-sink-")
    rng = np.random.default_rng(5)
    for i in range(3):
        arr = rng.integers(0, 256, (12, 10), dtype=np.uint8)
        os.makedirs(os.path.join(src, "u"), exist_ok=True)
        with open(os.path.join(src, "u", f"{i}.png"), "wb") as fh:
            fh.write(png_bytes(arr.tobytes(), 10, 12, 1))
    store = Store(spark, scratch_path(spark, "sink-store"))
    C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    pix = store.read("variant_rasters")
    mod = store.read("modified_images")
    assert pix.count() == mod.count() == 6
    assert pix.join(mod, "path", "left_anti").count() == 0
    shapes = {(r["height"], r["width"]) for r in pix.collect()}
    assert shapes == {(12, 10), (10, 12)}


def test_point_lookups(spark):
    df = spark.createDataFrame([(1, "aa", 5, 1), (2, "bb", 5, 2)],
                               "id long, hash string, modified_image_id long, hashing_method_id int")
    got = TB.point_lookup(df, ["id"], hash="bb", modified_image_id=5, hashing_method_id=2).collect()
    assert [r["id"] for r in got] == [2]
    with pytest.raises(LookupError):
        TB.strict_single(TB.point_lookup(df, ["id"], hash="zz"), "hash zz")
    assert sorted(r[0] for r in TB.distinct_ids(df, "hashing_method_id").collect()) == [1, 2]


def test_variant_cap_in_registry_order(spark):
    df = spark.createDataFrame([(1, list(range(64)))], "image_id long, px array<int>")
    assert R.grid_variants(df, 8, 8, limit=1).select("modification_id").collect()[0][0] == 1
    assert R.grid_variants(df, 8, 8).count() == len(R.MODIFICATIONS.names())


def test_register_and_replace_modification(spark):
    @R.MODIFICATIONS.register("flip_rows")
    class FlipRows:
        def grid(self, px, w, h):
            return F.flatten(F.reverse(F.transform(F.sequence(F.lit(0), h - 1),
                                                   lambda r: F.slice(px, r * w + 1, w)))), w, h

        def size(self, w, h):
            return w, h

        def raster(self, arr):
            return arr[::-1].copy()

    try:
        ids = R.MODIFICATIONS.ids()
        assert ids["flip_rows"] == len(ids)
        df = spark.createDataFrame([(1, list(range(64)))], "image_id long, px array<int>")
        out = {r["modification_id"]: r["vpx"] for r in R.grid_variants(df, 8, 8).collect()}
        assert out[ids["flip_rows"]][:8] == list(range(56, 64))
        before = R.MODIFICATIONS.ids()

        @R.MODIFICATIONS.register("rotate_90")  # re-register: replaced in place, same id
        class Rot(R.Rotate90):
            pass

        assert R.MODIFICATIONS.ids() == before
        assert isinstance(R.MODIFICATIONS.get("rotate_90"), Rot)
    finally:
        R.MODIFICATIONS._items.pop("flip_rows", None)
        R.MODIFICATIONS._items["rotate_90"] = R.Rotate90
