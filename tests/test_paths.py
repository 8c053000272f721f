"""User from path (FIXTURES §3) and URL adapter."""

import pytest
from pyspark.sql import functions as F

from imprint.sources.paths import decode_origin, stem, user_from_path, user_from_url


@pytest.mark.parametrize("path,user", [
    ("/root/x.png", "undefined"),
    ("/root/john.doe/x.png", "john"),
    ("/root/a/b/x.png", "b"),
    ("file:/root/a/b/x.png", "b"),
    ("file:///root//u3/17.png", "u3"),
])
def test_user_from_path(spark, path, user):
    out = spark.range(1).select(user_from_path(F.lit(path), "/root").alias("u")).first()["u"]
    assert out == user


@pytest.mark.parametrize("name,expected", [(".hid", ".hid"), ("a.", "a."), ("a.b.c", "a.b"), ("a..b", "a."),
                                           ("john.doe", "john"), ("plain", "plain")])
def test_stem_rules(spark, name, expected):
    assert spark.range(1).select(stem(F.lit(name)).alias("s")).first()["s"] == expected


def test_outside_root_raises(spark):
    with pytest.raises(Exception, match="outside the input root"):
        spark.range(1).select(user_from_path(F.lit("/elsewhere/a/x.png"), "/root")).collect()


@pytest.mark.parametrize("url,user", [
    ("http://h.example.com/fr/825?page=2&ref=x", "fr"),
    ("https://h.example.com/en/853/", "en"),
    ("https://blog.x.example.com/about", "blog.x.example"),
    ("https://x.example.com/", "undefined"),
])
def test_user_from_url(spark, url, user):
    assert spark.range(1).select(user_from_url(F.lit(url)).alias("u")).first()["u"] == user


def test_decode_origin_keeps_plus(spark):
    out = spark.range(1).select(decode_origin(F.lit("file:/r/a%20b/c+d.png")).alias("p")).first()["p"]
    assert out == "file:/r/a b/c+d.png"
