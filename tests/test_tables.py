"""Insert-or-ignore, first writer, serial ids, lookups, audits."""

import pytest
from pyspark.sql import functions as F

from imprint.operators import tables as TB


def test_first_by_key_is_first_by_order(spark):
    df = spark.createDataFrame([("d1", 5, 2), ("d1", 3, 2), ("d1", 3, 1), ("d2", 9, 1)],
                               "digest string, image_id long, modification_id int")
    out = sorted(tuple(r) for r in TB.first_by_key(df, ["digest"], ["image_id", "modification_id"]).collect())
    assert out == [("d1", 3, 1), ("d2", 9, 1)]
    dropped = TB.dropped_by_key(df, ["digest"], ["image_id", "modification_id"])
    assert dropped.count() == 2


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    out = TB.assign_ids(df, ["k"], 41, partitions=5).orderBy("k").collect()
    assert [r["id"] for r in out] == list(range(42, 1042))
    assert [r["k"] for r in out] == list(range(1000))


def test_insert_or_ignore_rerun_adds_nothing(spark):
    existing = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    incoming = spark.createDataFrame([("c",), ("a",), ("d",), ("c",)], "name string")
    new = TB.insert_or_ignore(existing, incoming, ["name"])
    assert sorted(tuple(r) for r in new.select("id", "name").collect()) == [(3, "c"), (4, "d")]
    both = existing.unionByName(new.select("id", "name"))
    assert TB.insert_or_ignore(both, incoming, ["name"]).count() == 0


def test_get_or_create(spark):
    existing = spark.createDataFrame([(1, "a")], "id long, name string")
    req = spark.createDataFrame([(10, "a"), (11, "z"), (12, "z")], "rid int, name string")
    with_id, created = TB.get_or_create(existing, req, ["name"])
    assert sorted((r["rid"], r["id"]) for r in with_id.collect()) == [(10, 1), (11, 2), (12, 2)]
    assert created.count() == 1


def test_strict_lookup_raises(spark):
    dim = spark.createDataFrame([(1, "base")], "id int, name string")
    req = spark.createDataFrame([("base",), ("nope",)], "n string")
    ok = TB.lookup_id(req.where("n = 'base'"), dim, "n", strict=True).collect()
    assert ok[0]["id"] == 1
    with pytest.raises(Exception, match="no id for name"):
        TB.lookup_id(req, dim, "n", strict=True).collect()


def test_orphans_and_duplicates(spark):
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    child = spark.createDataFrame([(1,), (3,), (None,), (3,)], "fk int")
    assert TB.orphans(child, "fk", parent, "pk").count() == 2
    d = TB.duplicate_keys(child, ["fk"]).collect()
    assert [(r["fk"], r["rows"]) for r in d] == [(3, 2)]


def test_keyset_page(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "id")
    page = [r["id"] for r in TB.keyset_page(df, 123, 100).collect()]
    assert page == list(range(123, 223))
