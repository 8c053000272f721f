"""The block-pair kernels: histograms, near pairs and nearest hashes against brute force, and what their plans hold."""

import random

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.operators import analytics as AN
from imprint.operators import block_pairs as BP
from imprint.operators import multi_index as MI
from imprint.operators import nearest_k as NK
from imprint.operators import registry as R
from imprint.sources.keyed import LISTING, KeyedTable
from imprint.sources.store import Store
from tests.test_plans import _plan

COLS = "id long, hash string, hashing_method_id int, image_id long"


def _rows(n, seed, bits=64):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(bits) for _ in range(max(1, n // 3))]
    rows = []
    for i in range(n):
        v = rnd.choice(base)
        for _ in range(rnd.randrange(20)):
            v ^= 1 << rnd.randrange(bits)
        ident = None if i % 41 == 7 else i // 2 if i % 10 == 1 else i  # ids missing and twice
        rows.append((ident, format(v, f"0{bits // 4}x"), i % 2 + 1, None if i % 9 == 0 else i // 4))
    return rows


def _pairs(rows):
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] < b[0] and a[2] == b[2]:
                yield a, b, bin(int(a[1], 16) ^ int(b[1], 16)).count("1")


def test_histograms_near_pairs_and_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(AN, "BAND_PARTITIONS_PER_SLOT", 1)
    rows = _rows(230, 5)
    fp = spark.createDataFrame(rows, COLS).repartition(3)
    hist = {}
    for a, b, d in _pairs(rows):
        key = (a[2], a[3] is not None and a[3] == b[3], d)
        hist[key] = hist.get(key, 0) + 1
    for engine in ("join", "arrow"):
        got = AN.pair_histogram(fp, engine=engine, target_pairs_per_group=900).collect()
        assert {(r[0], r[1], r[2]): r[3] for r in got} == hist
    for t in (3, 9, 14):
        near = sorted((a[0], b[0], d / 64, a[2]) for a, b, d in _pairs(rows) if d <= t)
        for kw in ({}, {"strategy": "bands"}, {"strategy": "bands", "hot": 10}):
            assert sorted(tuple(r) for r in AN.near_duplicates(fp, t, **kw).collect()) == near
    best = {}
    for a, b, d in _pairs(rows):
        for x, y in ((a, b), (b, a)):
            best[x[0]] = min(best.get(x[0], (99, 0)), (d, y[0]))
    want = sorted((k, v[1], v[0]) for k, v in best.items())
    for kw in ({}, {"engine": "arrow"}, {"target_pairs_per_group": 900}):
        assert sorted(tuple(r) for r in AN.nearest_hash(fp, **kw).collect()) == want


def test_nearest_by_bands_where_all_some_or_none_have_a_close_partner(spark, monkeypatch):
    monkeypatch.setattr(AN, "BAND_PARTITIONS_PER_SLOT", 1)
    rows = [(i, *r[1:]) for i, r in enumerate(_rows(120, 6))]
    fp = spark.createDataFrame(rows, COLS)
    want = sorted(tuple(r) for r in AN.nearest_hash(fp).collect())
    for bits in (0, 8, 15):
        got = AN.nearest_hash(fp, strategy="bands", band_bits=bits, target_pairs_per_group=400)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_tiles_cover_each_pair_once():
    rng = np.random.default_rng(1)
    n = BP.TILE[1] + BP.TILE[0] + 5  # more than one tile either way, none of them whole
    ids = np.sort(rng.integers(0, n * 2, n))  # some twice
    bits = rng.integers(0, 1 << 63, n).astype(np.uint64)
    d = np.bitwise_count(bits[:, None] ^ bits[None])
    counts = np.bincount(d[ids[:, None] < ids[None]], minlength=65)
    assert (BP._count((ids, bits, ids, bits, True)) == counts).all()
    best, _ = BP._nearest((ids, bits, ids, bits, True))
    key = d.astype(np.int64) << BP.ID_BITS | ids[None]
    key[ids[:, None] == ids[None]] = np.iinfo(np.int64).max
    assert (best == key.min(axis=1)).all()


def test_near_pairs_leave_in_batches(monkeypatch):
    monkeypatch.setattr(BP, "OUT_ROWS", 100)
    batch = pa.record_batch({"id": np.arange(200), "bits": np.zeros(200, np.int64), "role": np.zeros(200, np.int32)})
    out = list(BP.near(0)((pa.scalar(1, pa.int32()), pa.scalar(0), pa.scalar(0)), iter([batch])))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 200 * 199 // 2


def test_counts_near_pairs_and_nearest_never_make_rows_of_pairs(spark):
    fp = spark.createDataFrame(_rows(40, 7), COLS)
    for df in (AN.pair_histogram(fp, engine="join"), AN.near_duplicates(fp, 14), AN.nearest_hash(fp),
               AN.near_duplicates(fp, 14, strategy="bands")):
        text = _plan(df)
        assert "InArrow" in text and "Inner" not in text
    wide = spark.createDataFrame([(i, format(i * 7, "032x"), 1, i) for i in range(9)], COLS)
    assert AN.pair_histogram(wide, engine="join").count() and AN.near_duplicates(wide, 128).count() == 36


def test_hash_kernels_take_a_bounded_number_of_grids_a_call(spark, monkeypatch):
    monkeypatch.setattr(R, "RAGGED_PIXELS", 8 * 32 * 32)
    assert R._grids_a_call(R.HASHING_METHODS.get("dct-hash"), 8, 8) == 8  # they are resized to 32 x 32
    assert R._grids_a_call(R.HASHING_METHODS.get("averagehash"), 8, 8) == 128
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, [rnd.randrange(256) for _ in range(64)]) for i in range(50)],
                               "id long, px array<int>").coalesce(1)
    method = R.HASHING_METHODS.get("dct-hash")
    sizes = []

    class Watched:
        side = method.side

        def batch(self, grids):
            sizes.append(len(grids))
            return method.batch(grids)

    import pandas as pd

    px = pd.Series([np.array(r["px"]) for r in df.collect()])
    out = R.batch_hash_udf(Watched(), 8, 8).func(px)
    assert max(sizes) <= 8 and len(out) == 50
    monkeypatch.undo()
    assert list(out) == list(R.batch_hash_udf(method, 8, 8).func(px))


def test_probes_meet_what_brute_force_finds(spark):
    rows = _rows(200, 8)
    rows += [(1000 + i, rows[0][1], 1, None) for i in range(30)]  # one value of every band that many share
    fp = spark.createDataFrame(rows, COLS)
    for t, bands in ((14, 4), (5, 2), (3, 1)):
        near = sorted((a[0], b[0], d / 64, a[2]) for a, b, d in _pairs(rows) if d <= t)
        for hot in (None, 20):
            df = MI.near_pairs(fp, t, bands, hot=hot)
            assert sorted(tuple(r) for r in df.collect()) == near
    assert "Join" not in _plan(MI.near_pairs(fp, 14))  # no probe is shuffled


def test_probed_rows_are_met_in_bounded_parts():
    left, right = np.zeros(300, np.uint64), np.zeros(200, np.uint64)
    parts = list(BP._met(left, right, np.array([0, 1, 2], np.uint64), 16, most=1000))
    assert max(len(i) for i, _ in parts) <= 1000 and len(set(zip(*map(np.concatenate, zip(*parts))))) == 300 * 200


def test_the_k_nearest_of_a_block_are_exact_beyond_its_first_columns(monkeypatch):
    monkeypatch.setattr(NK, "FIRST", 16)
    monkeypatch.setattr(NK, "CELLS", 1000)
    rng = np.random.default_rng(4)
    n = 300
    ids = rng.integers(0, 250, n)  # some twice
    bits = rng.integers(0, 1 << 12, n)  # many ties
    table = pa.table({"role": np.r_[np.zeros(n, np.int32), np.ones(n, np.int32)], "id": np.r_[ids, ids], "bits": np.r_[bits, bits]})
    d = np.bitwise_count(bits[:, None] ^ bits[None]).astype(np.int64)
    for k in (1, 5, 20, 400):
        out = NK._kernel(k)((), table)
        got = sorted(zip(out["hash_id"].to_pylist(), out["k"].to_pylist()))
        want = sorted((int(ids[i]), key) for i in range(n) for key in sorted(
            int(d[i, j] << NK.ID_BITS | ids[j]) for j in range(n) if ids[j] != ids[i])[:k])
        assert got == want


def _nearest_table(x, ids, q, qids, **more):
    return pa.table({"role": np.r_[np.zeros(len(x), np.int32), np.ones(len(q), np.int32)], "id": np.r_[ids, qids],
                     "bits": np.r_[x, q].view(np.int64), **more})


def test_the_k_nearest_meet_few_rows_of_a_large_block():
    rng = np.random.default_rng(5)
    n = 30_000
    x = np.repeat(rng.integers(0, 1 << 64, n // 10, dtype=np.uint64), 10)  # ten near copies each
    for _ in range(3):
        x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    out = NK._kernel(5)((), _nearest_table(x, np.arange(n), x, np.arange(n)))
    assert sum(out["compared"].to_pylist()) < 0.2 * n * n  # all before
    got = np.array(out["k"]).reshape(-1, 5)
    ids = np.array(out["hash_id"]).reshape(-1, 5)[:, 0]
    for row in rng.integers(0, n, 200):
        d = np.bitwise_count(x ^ x[ids[row]]).astype(np.int64) << NK.ID_BITS | np.arange(n)
        d[ids[row]] = 1 << 62
        assert sorted(got[row]) == sorted(d)[:5]


def test_bands_find_the_k_nearest_whatever_the_rows(monkeypatch):
    for name, value in {"BANDED_FROM": 0, "TILE_COST": 0, "FIRST": 16, "CELLS": 1000, "HELD": 50, "VISITORS": 70}.items():
        monkeypatch.setattr(NK, name, value)
    rng = np.random.default_rng(6)
    n, k, left, banded = 300, 3, [], NK._Search.banded

    def spy(search):
        rest = banded(search)
        left.append(len(search.q) - len(rest))
        return rest
    monkeypatch.setattr(NK._Search, "banded", spy)
    far = rng.integers(0, 1 << 64, 9, dtype=np.uint64)
    for x in (rng.integers(0, 1 << 64, n, dtype=np.uint64), np.full(n, 1 << 63, np.uint64), rng.integers(0, 90, n).astype(np.uint64),
              far[rng.integers(0, 9, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))):
        ids = rng.integers(0, 250, n)  # some twice
        d = np.bitwise_count(x[:, None] ^ x[None]).astype(np.int64)
        want = [sorted(int(d[i, j] << NK.ID_BITS | ids[j]) for j in range(n) if ids[j] != ids[i])[:k] for i in range(n)]
        for bound in (None, [w[-1] >> NK.ID_BITS if i % 3 else None for i, w in enumerate(want)]):
            more = {} if bound is None else {"bound": pa.array([None] * n + bound, pa.int32())}
            out = NK._kernel(k)((), _nearest_table(x, ids, x, ids, **more))
            assert sorted(zip(out["hash_id"].to_pylist(), out["k"].to_pylist())) == sorted(
                (int(ids[i]), key) for i in range(n) for key in want[i])
    assert sum(left) > n  # many are done by bands alone


def test_cells_share_blocks_or_have_several():
    pivots = np.array([0, 1 << 20, 1, (1 << 64) - 1], np.uint64)
    placed = NK.place({0: 10, 1: 250, 2: 20, 3: 90}, pivots, 100)
    assert placed[1][1] == 3 and placed[0] == placed[2] and placed[3][0] != placed[0][0]
    taken = sorted({b for first, blocks in placed.values() for b in range(first, first + blocks)})
    assert taken == list(range(5))
    assert NK.place({2: 7}, pivots, 100) == {2: (0, 1)}


def test_pairs_are_written_without_a_sort_by_partition(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    pairs = [(1, 2, 0.5, 1), (1, 1, 0.0, 1), (7, 9, 0.25, 2)]
    df = spark.createDataFrame(pairs, "hash_id1 long, hash_id2 long, hamming_distance double, hashing_method_id int")
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda *a: 1 / 0)  # it sorts all pairs of a task
    store.write_matches(df, {1: 2, 2: 9})  # cut off: no manifest row
    assert store.write_matches(df, {1: 2, 2: 9}) == {1: 2, 2: 1}
    store.commit_matches({1: 2, 2: 9}, {1: 2, 2: 1})
    assert sorted(tuple(r) for r in store.read("matches").collect()) == sorted(pairs)


def test_small_buckets_share_a_task(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", T.StructType().add("id", "long").add("k", "long"), ["k"], rows_per_file=4)
    rows = spark.range(4000).select("id", (F.col("id") * 7).alias("k"))
    was = spark.conf.get(LISTING, None)
    table.append(rows)
    files = [f.name for f in (tmp_path / "t").rglob("*.parquet")]
    buckets = len(list((tmp_path / "t").rglob("bucket=*")))
    assert buckets > 500 and len(files) == buckets  # still one file a bucket
    assert len({f.split("-")[1] for f in files}) <= 4 * spark.sparkContext.defaultParallelism
    assert table.read().count() == 4000 and spark.conf.get(LISTING, None) == was
    key = table.near(spark.createDataFrame([(700,)], "k long"))
    assert key.count() < 50 and key.where("k = 700").count() == 1
