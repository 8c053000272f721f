"""Tables laid out by key: what a batch opens, merges, appends that were cut off, and the stored chain on them."""

import os
import random

import pytest
from pyspark.sql import types as T

from imprint.plans import chain as C
from imprint.session import scratch_path
from imprint.sources.keyed import KeyedTable
from imprint.sources.store import Store
from tests.test_scale_routes import _lot

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def _table(spark, **kw):
    return KeyedTable(spark, scratch_path(spark, "keyed"), SCHEMA, ["name"], **kw)


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_small_batch_opens_as_few_files_at_any_size(spark):
    opened = {}
    for n in (2_000, 20_000):
        t = _table(spark, rows_per_file=50)
        t.append(_rows(spark, [(i, f"k{i}") for i in range(n)]))
        assert len(t.read().inputFiles()) > n / 100
        batch = _rows(spark, [(0, f"k{i * 97}") for i in range(5)] + [(0, f"new{i}") for i in range(5)])
        near = t.near(batch)
        opened[n] = len(near.inputFiles())
        assert {f"k{i * 97}" for i in range(5)} <= {r["name"] for r in near.collect()}
    assert all(v <= 10 for v in opened.values())


def test_appends_inserts_and_merges_against_a_plain_list(spark):
    r = random.Random(5)
    t, want = _table(spark, rows_per_file=8, fanout=3), []
    for lot in range(9):
        names = [r.choice([None, f"n{r.randrange(60)}", "hot"]) for _ in range(r.randrange(1, 25))]
        rows = [(len(want) + i + 1, x) for i, x in enumerate(names)]
        assert t.append(_rows(spark, rows)) == len(rows)
        want += rows
        keys = [f"n{r.randrange(60)}" for _ in range(4)] + ["hot", None]
        got = {tuple(x) for x in t.near(_rows(spark, [(0, k) for k in keys])).collect()}
        assert got <= set(want) and {x for x in want if x[1] is not None and x[1] in keys} <= got
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted(want, key=str)
    assert t.count() == len(want) and t.max_id() == len(want)
    assert len(t.generations()) < 9  # merged
    known = {x[1] for x in want}
    batch = _rows(spark, [(0, "n1"), (0, "b"), (0, "a"), (0, "b"), (0, "hot")])
    fresh = sorted({"n1", "a", "b"} - known)
    assert t.insert(batch.select("name"), ["name"], ["name"]) == len(fresh)
    assert t.insert(batch.select("name"), ["name"], ["name"]) == 0
    added = {(x["id"], x["name"]) for x in t.read().where(f"id > {len(want)}").collect()}
    assert added == {(len(want) + i + 1, x) for i, x in enumerate(fresh)}
    again = KeyedTable(spark, t.path, SCHEMA, ["name"])  # another reader sees the same
    before = sorted(map(tuple, again.read().collect()), key=str)
    assert t.vacuum() > 0
    assert sorted(map(tuple, again.read().collect()), key=str) == before
    assert t.vacuum() == 0 and t.append(_rows(spark, [])) == 0


def test_an_append_that_was_cut_off_is_replaced(spark):
    t = _table(spark, rows_per_file=4)
    assert t.read().count() == 0 and t.folders(_rows(spark, [(0, "x")])) == [] and t.max_id() == 0
    t.append(_rows(spark, [(1, "a"), (2, "b")]))
    for b in range(8):  # rows of the next generation are there, its version isn't
        _rows(spark, [(90 + b, "lost")]).write.parquet(f"{t.path}/rows/gen=2/bucket={b}")
    assert t.read().count() == 2
    t.append(_rows(spark, [(3, "c")]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b"), (3, "c")]
    other = KeyedTable(spark, t.path, SCHEMA, ["name"])
    other.append(_rows(spark, [(4, "d")]))
    assert t.read().count() == 4 and t.insert(_rows(spark, [(0, "d"), (0, "e")]).select("name"), ["name"], ["name"]) == 1


def test_the_chain_on_many_small_files(spark):
    src = scratch_path(spark, "keyed-src")
    store = Store(spark, scratch_path(spark, "keyed-store"), rows_per_file=3)
    _lot(src, range(6), 1)
    assert C.ingest_folder(spark, store, src, "/v", store_rasters=True).hashes == 24
    assert max(g.bits for g in store.keyed["hashes"].generations()) >= 3
    _lot(src, range(6, 8), 2)
    second = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert (second.images, second.modified_images, second.hashes) == (2, 4, 8)
    again = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert (again.images, again.modified_images, again.hashes) == (0, 0, 0)
    assert store.read("variant_rasters").count() == 16
    assert sorted(r["id"] for r in store.read("hashes").collect()) == list(range(1, 33))
    one = store.read("images").limit(1)
    assert len(store.near("images", one).inputFiles()) <= len(store.keyed["images"].generations())


def test_an_earlier_layout_is_refused(spark):
    store = Store(spark, scratch_path(spark, "flat-store"))
    os.makedirs(store.path("images"))
    with pytest.raises(ValueError, match="not laid out by key"):
        store.init(["base"], ["averagehash"])
