"""Multi-index search, k nearest, the commit manifest, the raster sink, ordered scans, odd sizes and the run log."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.functions import hashing as H
from imprint.functions.bits import hex_hamming_distance
from imprint.operators import analytics as AN
from imprint.operators import match as M
from imprint.operators import multi_index as MI
from imprint.operators import nearest_k as NK
from imprint.operators import ordered as O
from imprint.operators import raster as RA
from imprint.operators import registry as R
from imprint.plans import chain as C
from imprint.plans import queries as Q
from imprint.session import scratch_path
from imprint.sources.images import png_bytes, read_images
from imprint.sources.store import RUNS, Store
from tests.conftest import SF001
from tests.test_plans import _plan


def _hashes(spark, bits, methods=None, ids=None):
    rows = [(int(ids[i]) if ids is not None else i, f"{int(b):016x}", int(methods[i]) if methods is not None else 1)
            for i, b in enumerate(bits)]
    return spark.createDataFrame(rows, "id long, hash string, hashing_method_id int").repartition(4)


def _clustered(seed, centres, each, flips):
    r = np.random.default_rng(seed)
    out = []
    for c in r.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(each):
            x = int(c)
            for b in r.integers(0, 64, r.integers(0, flips + 1)):
                x ^= 1 << int(b)
            out.append(x)
    return out


def _near(bits, t, methods):
    return sorted((i, j) for i in range(len(bits)) for j in range(i + 1, len(bits))
                  if methods[i] == methods[j] and (bits[i] ^ bits[j]).bit_count() <= t)


@pytest.mark.parametrize("t,bands", [(0, 4), (2, 4), (5, 3), (14, 4), (14, 6), (20, 4)])
def test_multi_index_is_exact(spark, t, bands):
    bits = _clustered(t, 12, 9, 14) + [0] * 30  # and a hot hash
    methods = [1 + i % 2 for i in range(len(bits))]
    h = _hashes(spark, bits, methods)
    want = _near(bits, t, methods)
    for hot in (4096, 5):  # with 5, hot values are block pairs
        got = MI.near_pairs(h, t, bands, hot=hot).collect()
        assert sorted((r["hash_id1"], r["hash_id2"]) for r in got) == want
        assert all(round(r["hamming_distance"] * 64) == (bits[r["hash_id1"]] ^ bits[r["hash_id2"]]).bit_count() for r in got)


def test_multi_index_layout_and_candidates(spark):
    for t in range(0, 30):
        for bands in range(1, 9):
            assert sum(r + 1 for r in MI.radii(t, bands)) == t + 1
    assert [len(MI.probes(w, r)) for _, w, r in MI.layout(14, 64, 4)] == [697, 697, 697, 137]
    fp = Q.stored_fingerprints(spark, SF001)
    n = [r["count"] for r in fp.groupBy("hashing_method_id").count().collect()]
    assert 0 < MI.candidates(fp, 14) < 0.1 * sum(c * (c - 1) // 2 for c in n)
    assert MI.candidates(fp, 14) * 5 < AN.band_candidates(fp, 14)
    assert MI.near_pairs(fp.limit(0), 14).count() == 0
    with pytest.raises(ValueError, match="one hash width"):
        MI.near_pairs(fp.withColumn("hash", F.concat("hash", "hash")), 14)


def test_k_nearest_is_exact_and_skips_far_cells(spark):
    bits = _clustered(3, 40, 25, 6) + [7] * 20
    methods = [1 + (i % 5 == 0) for i in range(len(bits))]
    found = NK.search(_hashes(spark, bits, methods), 5, block=32)
    got = {}
    for r in found.neighbours.collect():
        got.setdefault(r["hash_id"], []).append((r["rank"], r["neighbour_id"], r["distance_bits"]))
    for i, b in enumerate(bits):
        others = sorted(((b ^ o).bit_count(), j) for j, o in enumerate(bits) if j != i and methods[j] == methods[i])[:5]
        assert sorted(got[i]) == [(k, j, d) for k, (d, j) in enumerate(others, 1)]
    assert found.skipped > 0.5


def test_k_nearest_edges(spark):
    two = NK.search(_hashes(spark, [1, 2, 3], [1, 1, 2]), 5).neighbours.collect()
    assert sorted(map(tuple, two)) == [(0, 1, 1, 2), (1, 1, 0, 2)]  # a lone hash of its method has no neighbour
    assert NK.search(_hashes(spark, [1]).limit(0), 5).neighbours.count() == 0
    with pytest.raises(ValueError, match="ids in"):
        NK.search(_hashes(spark, [1, 2], ids=[-1, 5]), 2)


def _png(folder, rel, arr):
    p = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(png_bytes(arr.tobytes(), arr.shape[1], arr.shape[0], 1 if arr.ndim == 2 else arr.shape[2]))


def _lot(src, ids, seed):
    r = np.random.default_rng(seed)
    for i in ids:
        _png(src, f"u{i % 2}/{i}.png", r.integers(0, 256, (12, 12), dtype=np.uint8))


def _pairs(store):
    return sorted((r["hashing_method_id"], r["hash_id1"], r["hash_id2"], r["hamming_distance"])
                  for r in store.read("matches").collect())


def test_a_match_that_was_cut_off_is_redone(spark, monkeypatch):
    src = tempfile.mkdtemp(prefix="imprint-cut-")
    _lot(src, range(4), 1)
    store, whole = (Store(spark, scratch_path(spark, n)) for n in ("cut", "whole"))
    C.ingest_folder(spark, store, src, "/v")
    first = C.match_new(spark, store)
    _lot(src, range(4, 7), 2)
    C.ingest_folder(spark, store, src, "/v")
    # the second run dies after some pairs are written, before the manifest row
    with monkeypatch.context() as m:
        m.setattr(Store, "commit_matches", lambda self, upto, counts: (_ for _ in ()).throw(RuntimeError("lost driver")))
        with pytest.raises(RuntimeError, match="lost driver"):
            C.match_new(spark, store)
    half = store.path("matches")
    folders = [os.path.join(d, f) for d, _, fs in os.walk(half.replace("file:", "")) for f in fs if f.endswith(".parquet")]
    late = [f for f in folders if "after=-1" not in f]
    assert late
    os.remove(late[0])  # half of its files are there
    assert store.read("matches").count() == first  # none of it is seen
    _lot(src, range(7, 8), 3)  # and more hashes arrive before the next run
    C.ingest_folder(spark, store, src, "/v")
    second = C.match_new(spark, store)
    assert C.match_new(spark, store) == 0
    n = store.read("hashes").count() // 2
    assert first + second == store.read("matches").count() == n * (n + 1)
    C.ingest_folder(spark, whole, src, "/v")
    C.match_new(spark, whole)
    assert len(_pairs(store)) == len(_pairs(whole)) == len(set(_pairs(store)))
    assert store.read("hashes").count() == whole.read("hashes").count()
    assert spark.read.parquet(store.path(RUNS)).count() == 4  # two runs, two methods
    log = store.log()
    assert log.counted("match") == first + second
    states = sorted((r["state"], r["counted"] or 0, r["error"]) for r in log.status().where("stage = 'match'").collect())
    assert states == sorted([("done", first, None), ("done", second, None), ("done", 0, None), ("failed", 0, "lost driver")])


def test_pixels_are_written_once_and_never_exchanged(spark):
    src = tempfile.mkdtemp(prefix="imprint-sink-")
    r = np.random.default_rng(5)
    _png(src, "a/1.png", r.integers(0, 256, (9, 14), dtype=np.uint8))
    _png(src, "a/2.png", r.integers(0, 256, (7, 5, 3), dtype=np.uint8))
    _png(src, "b/3.png", np.full((6, 6), 9, dtype=np.uint8))
    _png(src, "b/4.png", np.full((6, 6), 9, dtype=np.uint8))  # same content: no raster of its own
    with open(os.path.join(src, "b", "bad.png"), "wb") as fh:
        fh.write(b"no image")
    store = Store(spark, scratch_path(spark, "sink"))
    result = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert (result.modified_images, result.quarantined) == (5, 1)
    again = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert again.modified_images == 0
    back = C.map_rasters(store, lambda px: (RA.content_digest(px), px.size), "digest string, n long")
    rows = back.collect()
    assert len(rows) == 5 and all(x["path"] == f"/v/{x['digest']}.png" for x in rows)
    assert sorted((x["height"], x["width"], x["n_channels"]) for x in rows) == [
        (5, 7, 3), (6, 6, 1), (7, 5, 3), (9, 14, 1), (14, 9, 1)]
    assert sorted(x["n"] for x in rows) == sorted(x["height"] * x["width"] * x["n_channels"] for x in rows)
    for df in (back, RA.raster_pixels(read_images(spark, src), keys=("path",))):
        lines = _plan(df).splitlines()
        pixel_step = max(i for i, ln in enumerate(lines) if "MapInPandas" in ln)
        exchanges = [i for i, ln in enumerate(lines) if "Exchange" in ln]
        # what the pixel step reads comes straight from a scan; exchanges above it carry its narrow result
        assert all(i < pixel_step or "data#" not in "".join(lines[i:]) for i in exchanges)
    wide = C._pixel_rows(spark, store, store.read(C.RASTERS).first()["batch"])
    assert "data" not in _plan(wide.select("path", "digest")).split("ReadSchema")[1]


def test_ordered_walk_equals_a_scan_and_a_page_opens_one_file(spark):
    r = np.random.default_rng(6)
    ids = r.permutation(5000)[:700]
    h = _hashes(spark, r.integers(0, 1 << 63, 700, dtype=np.uint64), [1 + (i % 3 == 0) for i in range(700)], ids)
    o = O.write_ordered(h, scratch_path(spark, "ordered"), rows_per_file=60)
    assert o.index.count() >= 12 and o.methods() == [1, 2]
    for method in (1, 2):
        want = [(x["id"], x["hash"]) for x in h.where(F.col("hashing_method_id") == method).orderBy("id").collect()]
        pages = list(o.walk(method, 37))
        got = [(x["id"], x["hash"]) for p in pages for x in p.rows.orderBy("id").collect()]
        assert got == want
        token = pages[1].next_start
        assert [x["id"] for p in o.walk(method, 37, token) for x in p.rows.orderBy("id").collect()] == [i for i, _ in want][74:]
        numbered = o.pages(37).where(F.col("hashing_method_id") == method).collect()
        assert sorted((x["page"], x["id"]) for x in numbered) == [(k // 37, i) for k, (i, _) in enumerate(want)]
        assert all(len(p.files) <= 2 for p in pages)
    inside = [p for p in o.walk(1, 10)]
    assert sum(len(p.files) == 1 for p in inside) > len(inside) // 2
    assert o.page(1, 10_000, 5).rows.count() == 0 and o.page(1, 10_000, 5).next_start is None


def test_hash_sizes_of_any_bit_count(spark):
    r = np.random.default_rng(8)
    grids = [r.integers(0, 256, 81).tolist() for _ in range(40)] + [[5] * 81, [0] * 40 + [255] * 41]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "id int, px array<int>")
    got = {x["id"]: (x["a"], x["b"]) for x in df.select(
        "id", H.average_hash("px", 9).alias("a"), R.batch_hash_udf(R.AverageHash(9), 9, 9)("px").alias("b")).collect()}
    for i, g in enumerate(grids):
        flags = "".join("1" if p * 81 >= sum(g) else "0" for p in g)
        want = f"{int(flags, 2):020x}"
        assert got[i] == (want, want)
        assert RA.bits_hex(R.AverageHash(9).raster(np.array(g, np.uint8).reshape(9, 9)), 81) == want
    assert {len(a) for a, _ in got.values()} == {20, 21}
    five = df.select(H.average_hash(F.slice("px", 1, 25), 5).alias("h")).collect()
    assert all(x["h"] == f"{int(''.join('1' if p * 25 >= sum(g[:25]) else '0' for p in g[:25]), 2):06x}"
               for x, g in zip(five, grids))
    mixed = spark.createDataFrame([(i, a, 1) for i, (a, _) in got.items()], "id long, hash string, hashing_method_id int")
    with pytest.raises(Exception, match="Hashes must have the same length"):
        M.match_pairs(mixed).count()
    pair = spark.createDataFrame([("ff", "fff")], "a string, b string")
    with pytest.raises(Exception, match="Hashes must have the same length"):
        pair.select(hex_hamming_distance("a", "b")).collect()
    same = [a for a, _ in got.values() if len(a) == 21]
    h = spark.createDataFrame([(i, a, 1) for i, a in enumerate(same)], "id long, hash string, hashing_method_id int")
    for x in M.match_pairs(h).collect():
        d = (int(same[x["hash_id1"]], 16) ^ int(same[x["hash_id2"]], 16)).bit_count()
        assert abs(x["hamming_distance"] - d / 84) < 1e-12


def test_a_registered_modification_of_any_size_has_equal_forms(spark):
    mods = R.Registry("modification")
    for name, cls in (("base", R.Base), ("rotate_90", R.Rotate90), ("crop_border", Q.CropBorder)):
        mods.register(name)(cls)
    r = np.random.default_rng(12)
    arrays = [r.integers(0, 256, s, dtype=np.uint8) for s in ((8, 8), (9, 17), (32, 32), (17, 9), (8, 8), (3, 3))]
    df = spark.createDataFrame([(i, a.reshape(-1).tolist(), a.shape[1], a.shape[0]) for i, a in enumerate(arrays)],
                               "image_id long, px array<int>, width int, height int").repartition(2)
    variants = R.grid_variants(df, F.col("width"), F.col("height"), registry=mods)
    got = {(x["image_id"], x["modification_id"], x["hashing_method_id"]): x["hash"]
           for x in R.ragged_fingerprints(variants).collect()}
    for i, a in enumerate(arrays):
        for mid, (_, mod) in enumerate(mods.items(), 1):
            for name, method in R.HASHING_METHODS.items():
                want = RA.bits_hex(method.raster(mod.raster(a)), method.nbits)
                assert got[i, mid, R.HASHING_METHODS.ids()[name]] == want


def test_shapes_are_named_by_the_caller(spark):
    h = _hashes(spark, range(50))
    assert M.plan_match(h).shape == "blocks"
    with pytest.raises(ValueError, match="too many to broadcast"):
        M.plan_match(h, shape="broadcast", broadcast_max_bytes=100)
    with pytest.raises(ValueError, match="shape"):
        M.plan_match(h, shape="auto")
