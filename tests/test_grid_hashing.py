"""Grid functions and fingerprints: golden cases, Column vs numpy vs plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.functions import grid as G
from imprint.functions import hashing as H
from imprint.functions.resample import resize_grid
from imprint.operators import raster as RA
from imprint.operators.registry import HASHING_METHODS
from tests.conftest import SF01


# ---- independent plain-loop reimplementation (test oracle) -------------------------------------

def loop_weights(n_in, n_out):
    scale = n_in / n_out
    fs = max(scale, 1.0)
    sup = 3.0 * fs

    def sinc(x):
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    def lan(x):
        return sinc(x) * sinc(x / 3.0) if -3.0 <= x < 3.0 else 0.0

    rows = []
    for o in range(n_out):
        c = (o + 0.5) * scale
        lo = max(int(c - sup + 0.5), 0)
        hi = min(int(c + sup + 0.5), n_in)
        w = [lan((x - c + 0.5) / fs) for x in range(lo, hi)]
        tot = sum(w)
        w = [v / tot for v in w] if tot else w
        rows.append((lo, [int(math.floor(v * 4194304 + 0.5)) if v >= 0 else -int(math.floor(-v * 4194304 + 0.5))
                          for v in w]))
    return rows


def loop_resize(img, out_w, out_h):
    h, w = len(img), len(img[0])
    if out_w != w:
        ws = loop_weights(w, out_w)
        img = [[min(255, max(0, (2097152 + sum(k * row[lo + t] for t, k in enumerate(kk))) >> 22))
                for lo, kk in ws] for row in img]
    if out_h != h:
        ws = loop_weights(h, out_h)
        cols = len(img[0])
        img = [[min(255, max(0, (2097152 + sum(k * img[lo + t][x] for t, k in enumerate(kk))) >> 22))
                for x in range(cols)] for lo, kk in ws]
    return img


def loop_dct_hash(img32):
    b = [[round(math.cos(math.pi * u * (2 * y + 1) / 64) * (1 << 20)) for y in range(32)] for u in range(8)]
    r = [[sum(b[u][y] * img32[y][x] for y in range(32)) for x in range(32)] for u in range(8)]
    d = [sum(r[u][x] * b[v][x] for x in range(32)) for u in range(8) for v in range(8)]
    s = sorted(d)
    return "".join("1" if 2 * c > s[31] + s[32] else "0" for c in d)


def loop_avg_hash(img8):
    flat = [v for row in img8 for v in row]
    return "".join("1" if v * len(flat) >= sum(flat) else "0" for v in flat)


def hexbits(bitstr):
    return format(int(bitstr, 2), "016x")


# ---- golden cases -------------------------------------------------------------------------------

def test_rotate_golden(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6],)], "px array<int>")
    out = df.select(G.rotate90_ccw("px", F.lit(3), F.lit(2)).alias("r")).first()["r"]
    assert out == [3, 6, 2, 5, 1, 4]


def test_rotate_four_times_identity(spark):
    rnd = random.Random(1)
    px = [rnd.randrange(256) for _ in range(12)]
    df = spark.createDataFrame([(px,)], "px array<int>")
    c = F.col("px")
    w, h = 4, 3
    for _ in range(4):
        c, w, h = G.rotate90_ccw(c, F.lit(w), F.lit(h)), h, w
    assert df.select(c.alias("r")).first()["r"] == px


def test_uniform_and_black_hashes(spark):
    rows = [([0] * 1024,), ([128] * 1024,), ([255] * 1024,)]
    df = spark.createDataFrame(rows, "px array<int>")
    out = df.select(H.dct_hash("px").alias("d"),
                    H.average_hash(resize_grid("px", 32, 32, 8, 8)).alias("a")).collect()
    assert out[0]["d"] == "0000000000000000"
    assert out[1]["d"] == "8000000000000000" and out[2]["d"] == "8000000000000000"
    assert all(r["a"] == "ffffffffffffffff" for r in out)


def test_embedding_goldens(spark):
    emb = spark.read.parquet(f"{SF01}/embeddings.parquet")
    g = emb.select("vec_id", G.embedding_to_grid("embedding").alias("px"))
    ah = {r[0]: r[1] for r in g.where("vec_id < 2").select("vec_id", H.average_hash("px")).collect()}
    assert ah == {0: "c8e0726f278ebbc6", 1: "715aeec512b83fb4"}
    t = G.tile_grids(g, "vec_id", "px")
    assert t.count() == 32  # 500 rows: the last image has four tiles, the others are black
    last = t.where("image_id = 31").first()["px"]
    assert len(last) == 1024 and any(last[:256]) and not any(last[256:])
    d = {r[0]: r[1] for r in t.where("image_id < 2").select("image_id", H.dct_hash("px")).collect()}
    assert d == {0: "d0aa3f0124aaafdd", 1: "fd0a7b33e13330c1"}


def test_greyscale_formula(spark):
    df = spark.createDataFrame([([10, 200, 30, 255, 255, 255, 0, 0, 0, 7],)], "v array<int>")
    out = df.select(G.greyscale_interleaved("v", 3).alias("g")).first()["g"]
    expect = [(10 * 19595 + 200 * 38470 + 30 * 7471 + 32768) >> 16, 255, 0]
    assert out == expect


# ---- three implementations agree --------------------------------------------------------------

@pytest.mark.parametrize("size", [(8, 8), (32, 32), (13, 7), (50, 40)])
def test_resize_column_numpy_loops_agree(spark, size):
    w, h = size
    rnd = random.Random(w * 100 + h)
    imgs = [[[rnd.randrange(256) for _ in range(w)] for _ in range(h)] for _ in range(3)]
    df = spark.createDataFrame([([v for row in im for v in row],) for im in imgs], "px array<int>")
    for ow, oh in ((8, 8), (32, 32)):
        col = [r[0] for r in df.select(resize_grid("px", w, h, ow, oh)).collect()]
        for im, c in zip(imgs, col):
            expect = loop_resize(im, ow, oh)
            assert c == [v for row in expect for v in row]
            assert RA.resize_np(np.array(im, dtype=np.uint8), ow, oh).tolist() == expect


def test_fingerprint_engines_agree(spark):
    rnd = random.Random(7)
    imgs = [[rnd.randrange(256) for _ in range(64)] for _ in range(20)] + [[77] * 64, [0] * 64]
    df = spark.createDataFrame([(i, px) for i, px in enumerate(imgs)], "id int, px array<int>")
    for name, method in HASHING_METHODS.items():
        from imprint.operators.registry import batch_hash_udf

        col = dict(df.select("id", method.grid(F.col("px"), 8, 8)).collect())
        arrow = dict(df.select("id", batch_hash_udf(method, 8, 8)("px")).collect())
        assert col == arrow
        for i, px in enumerate(imgs):
            img = [px[r * 8:(r + 1) * 8] for r in range(8)]
            if name == "averagehash":
                expect = hexbits(loop_avg_hash(loop_resize(img, 8, 8)))
            else:
                expect = hexbits(loop_dct_hash(loop_resize(img, 32, 32)))
            assert col[i] == expect
            assert format(method.raster(np.array(img, dtype=np.uint8)), "016x") == expect
