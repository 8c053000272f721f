"""All-pairs match: pair counts, shapes agree, incremental = full."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from imprint.operators import match as M


def _hashes(spark, spec, seed=3):
    rnd = random.Random(seed)
    rows, i = [], 0
    for m, n in spec:
        for _ in range(n):
            rows.append((i, format(rnd.getrandbits(64), "016x"), m))
            i += 1
    return spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")


def _rows(df):
    return sorted(tuple(r) for r in df.select("hash_id1", "hash_id2", "hamming_distance", "hashing_method_id").collect())


def test_golden_pair_count(spark):
    h = _hashes(spark, [(1, 3), (2, 2)])
    out = M.match_pairs(h)
    assert out.count() == 9
    assert out.where("hash_id1 = hash_id2").count() == 5
    assert out.where("hash_id1 > hash_id2").count() == 0


def test_shapes_agree_and_triangle(spark):
    h = _hashes(spark, [(1, 120), (2, 45)])
    a = _rows(M.match_pairs(h, shape="broadcast"))
    b = _rows(M.match_pairs(h, shape="blocks", target_pairs_per_task=300))
    assert a == b
    assert len(a) == 120 * 121 // 2 + 45 * 46 // 2
    # brute force in Python
    src = {r["id"]: (int(r["hash"], 16), r["hashing_method_id"]) for r in h.collect()}
    ids = sorted(src)
    brute = sorted((i, j, bin(src[i][0] ^ src[j][0]).count("1") / 64, src[i][1])
                   for i in ids for j in ids if i <= j and src[i][1] == src[j][1])
    assert a == brute


def test_block_plan_scales_blocks_with_method_size(spark):
    h = _hashes(spark, [(1, 400), (2, 20)])
    p = M.plan_match(h, shape="blocks", target_pairs_per_task=1000)
    assert p.blocks[1] > p.blocks[2]


def test_block_partitions_are_bounded_by_the_slots():
    """A hundred million hashes ask for a small multiple of the slots, in blocks that fit a task."""
    for n in (1_000, 10_000_000, 100_000_000, 1_000_000_000):
        blocks, parts = M.plan_blocks({1: (n, 64), 2: (n // 3, 64)}, slots=4000)
        assert 4000 <= parts <= 4000 * M.PARTITIONS_PER_SLOT
        assert all(rows / blocks[m] <= 110_000 for m, rows in ((1, n), (2, n // 3)))


def test_incremental_equals_full(spark):
    h = _hashes(spark, [(1, 60), (2, 30)], seed=11)
    old = h.where("id % 3 <> 0")
    new = h.where("id % 3 = 0")
    inc = _rows(M.match_pairs(new).unionByName(M.match_rectangle(new, old)).unionByName(M.match_pairs(old)))
    assert inc == _rows(M.match_pairs(h))
    rect_blocks = M.match_rectangle(new, old, target_pairs_per_task=50)
    assert _rows(rect_blocks) == _rows(M.match_rectangle(new, old))


def test_progress_observation(spark):
    h = _hashes(spark, [(1, 10)])
    df, obs = M.match_progress(M.match_pairs(h))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["matched"] == 55


def test_written_pairs_take_little_room(spark, tmp_path):
    rnd = random.Random(8)
    ids = rnd.sample(range(10**6), 1500)
    rows = [(i if n % 97 else None if n else ids[5], f"{rnd.getrandbits(64):016x}", 1 + (n % 3 == 0)) for n, i in enumerate(ids)]
    h = spark.createDataFrame(rows, "id long, hash string, hashing_method_id int")
    want = Counter()
    for m in (1, 2):
        some = [(i, int(x, 16)) for i, x, method in rows if method == m and i is not None]
        for i, x in some:
            for j, y in some:
                if i <= j:
                    want[m, (x ^ y).bit_count() / 64] += 1
    for shape, most in (("broadcast", 1.6), ("blocks", 1.6)):  # bytes a pair; broadcast had 2.1
        out = f"{tmp_path}/{shape}"
        M.match_pairs(h.where("id is not null"), shape=shape).coalesce(1).write.parquet(out)
        size = sum(os.path.getsize(os.path.join(out, f)) for f in os.listdir(out) if f.endswith(".parquet"))
        pairs = spark.read.parquet(out)
        got = {(r["hashing_method_id"], r["hamming_distance"]): r["count"] for r in pairs.groupBy(
            "hashing_method_id", "hamming_distance").count().collect()}
        assert got == want and pairs.where("hash_id1 > hash_id2").count() == 0
        assert size < most * sum(want.values())
    missing = M.match_pairs(h, shape="broadcast").groupBy("hashing_method_id").count().collect()  # no id: no pair
    assert {r["hashing_method_id"]: r["count"] for r in missing} == {
        m: sum(n for (k, _), n in want.items() if k == m) for m in (1, 2)}


def test_tiles_cut_the_ids_evenly(spark):
    h = spark.range(3000).selectExpr("id * 7 as id", "lpad(hex(id), 16, '0') as hash", "if(id < 300, 1, 2) as hashing_method_id")
    plan = M.plan_match(h, shape="broadcast")
    assert {m: len(c) for m, c in plan.cuts.items()} == {1: 1, 2: 10}
    ends = [-1, *plan.cuts[2], 3000 * 7]
    assert max((b - a) / 7 for a, b in zip(ends, ends[1:])) < 600
    same = h.withColumn("id", F.lit(4).cast("long")).withColumn("hash", F.lit("0" * 16))
    assert M.match_pairs(same.limit(400), shape="broadcast").count() == 300 ** 2 + 100 ** 2
