"""User-registered methods may be wider than 64 bits (hash_size 16 -> 256 bits)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.operators import match as M
from imprint.operators.registry import AverageHash, DCTHash, batch_hash_udf


def test_wide_average_and_dct_hash_engines_agree(spark):
    rnd = random.Random(4)
    imgs = [[rnd.randrange(256) for _ in range(40 * 40)] for _ in range(6)]
    df = spark.createDataFrame([(i, px) for i, px in enumerate(imgs)], "id int, px array<int>")
    for method in (AverageHash(hash_size=16), DCTHash(hash_size=12)):
        col = dict(df.select("id", method.grid(F.col("px"), 40, 40)).collect())
        arrow = dict(df.select("id", batch_hash_udf(method, 40, 40)("px")).collect())
        assert col == arrow
        for i, px in enumerate(imgs):
            v = method.raster(np.array(px, dtype=np.uint8).reshape(40, 40))
            assert col[i] == format(v, f"0{method.nbits // 4}x")
            assert len(col[i]) == method.nbits // 4


def test_mixed_width_pairs_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, format(rnd.getrandbits(64), "016x"), 1) for i in range(30)]
    rows += [(100 + i, format(rnd.getrandbits(256), "064x"), 2) for i in range(25)]
    h = spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")
    got = sorted(tuple(r) for r in M.match_pairs(h).collect())
    src = {r[0]: r for r in rows}
    brute = sorted((a, b, bin(int(src[a][1], 16) ^ int(src[b][1], 16)).count("1") / (len(src[a][1]) * 4), src[a][2])
                   for a in src for b in src if a <= b and src[a][2] == src[b][2])
    assert got == brute
    blocks = sorted(tuple(r) for r in M.match_pairs(h, shape="blocks", target_pairs_per_task=50).collect())
    assert blocks == brute


def test_mixed_lengths_within_a_method_raise(spark):
    h = spark.createDataFrame([(1, "ff" * 8, 1), (2, "ff" * 32, 1)], "id long, hash string, hashing_method_id int")
    with pytest.raises(Exception, match="Hashes must have the same length"):
        M.match_pairs(h).collect()


def test_rectangle_rejects_mixed_widths_across_sides(spark):
    a = spark.createDataFrame([(1, "ff" * 8, 1)], "id long, hash string, hashing_method_id int")
    b = spark.createDataFrame([(2, "ff" * 32, 1)], "id long, hash string, hashing_method_id int")
    with pytest.raises(ValueError, match="same length"):
        M.match_rectangle(a, b)


@pytest.mark.parametrize("nbits", [64, 128, 144, 256])
def test_nearest_hash_of_any_width_brute_force(spark, nbits):
    from imprint.operators.analytics import nearest_hash

    rnd = random.Random(nbits)
    rows = [(i, format(rnd.getrandbits(nbits), f"0{nbits // 4}x"), 1) for i in range(20)]
    rows += [(50, "0" * (nbits // 4), 2), (51, "f" * (nbits // 4), 2)]
    got = {r.hash_id: (r.nearest_id, r.distance_bits) for r in nearest_hash(
        spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")).collect()}
    for i, h, m in rows:
        best = min((bin(int(h, 16) ^ int(o, 16)).count("1"), j) for j, o, n in rows if j != i and n == m)
        assert got[i] == best[::-1]


def test_threshold_sweep_reaches_the_method_width(spark):
    from imprint.operators.analytics import threshold_sweep

    hist = spark.createDataFrame([(1, True, 100, 3), (1, False, 180, 7), (2, False, 5, 1)],
                                 "hashing_method_id int, same_image boolean, distance_bits int, pairs long")
    sweep = threshold_sweep(hist)
    assert dict(sweep.groupBy("hashing_method_id").agg(F.max("threshold_bits")).collect()) == {1: 180, 2: 64}


def test_store_reads_before_any_match_and_without_markers(spark, tmp_path):
    import os

    from imprint.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    store.init(["base"], ["averagehash"])
    store.views()
    assert spark.sql("SELECT * FROM matches").count() == 0
    for base, _, files in os.walk(store.root):
        for f in files:
            if "_SUCCESS" in f:
                os.remove(os.path.join(base, f))
    again = Store(spark, store.root)
    again.init(["base"], ["averagehash"])
    assert again.read("users").count() == 1 and again.read("modifications").count() == 1
