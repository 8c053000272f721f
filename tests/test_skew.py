"""Hot keys: a third of all rows on one digest, one band value, one method."""

import random

from pyspark.sql import functions as F

from imprint.operators import analytics as AN
from imprint.operators import match as M
from imprint.operators.hot_keys import cut_hot
from imprint.operators.tables import first_by_key


def test_hot_digest_first_writer(spark):
    n = 3000
    rows = [("hot" if i % 3 == 0 else f"d{i}", (i * 7919) % n, i % 2 + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "digest string, image_id long, modification_id int").repartition(8)
    out = {r["digest"]: (r["image_id"], r["modification_id"]) for r in
           first_by_key(df, ["digest"], ["image_id", "modification_id"]).collect()}
    hot = min((iid, mid) for d, iid, mid in rows if d == "hot")
    assert out["hot"] == hot
    assert len(out) == 1 + sum(1 for d, _, _ in rows if d != "hot")


def test_hot_band_near_duplicates(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(240):
        if i % 3 == 0:  # a third share their top 16 bits (one hot band value)
            v = (0xABCD << 48) | rnd.getrandbits(48)
        else:
            v = rnd.getrandbits(64)
        rows.append((i, format(v, "016x"), 1))
    fp = spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")
    for t in (3, 6):
        got = sorted((r[0], r[1]) for r in AN.near_duplicates(fp, t, strategy="bands", hot=8 if t == 3 else 4096).collect())
        brute = sorted((a[0], b[0]) for a in rows for b in rows
                       if a[0] < b[0] and bin(int(a[1], 16) ^ int(b[1], 16)).count("1") <= t)
        assert got == brute


def test_dominant_method_gets_more_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, format(rnd.getrandbits(64), "016x"), 1 if i % 10 else 2) for i in range(600)]
    h = spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")
    plan = M.plan_match(h, shape="blocks", target_pairs_per_task=2000)
    assert plan.blocks[1] > plan.blocks[2]
    got = M.match_pairs(h, plan=plan).groupBy("hashing_method_id").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 540 * 541 // 2, 2: 60 * 61 // 2}


def test_hot_keys_are_cut_into_block_pairs(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(8)
    left, right, on = cut_hot(df, df, ["k"], hot=100)
    pairs = left.select(F.col("id").alias("a"), *on).join(right.select(F.col("id").alias("b"), *on), on)
    plain = df.select(F.col("id").alias("a"), "k").join(df.select(F.col("id").alias("b"), "k"), "k")
    assert pairs.count() == plain.count() == pairs.select("a", "b").distinct().count()
    for side in (left, right):
        assert side.groupBy(*on).count().agg(F.max("count")).first()[0] < 200  # 1000 rows are hot
    cold = cut_hot(df, df, ["k"], hot=1000)
    assert cold[2] == ["k"] and cold[0] is df
