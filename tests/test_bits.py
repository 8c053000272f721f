"""Golden distances and properties of the bit helpers (FIXTURES §3)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from imprint.functions.bits import bits_to_hex, hex_hamming_distance, hex_to_bits


def _dist(spark, a, b):
    return spark.range(1).select(hex_hamming_distance(F.lit(a), F.lit(b)).alias("d")).first()["d"]


@pytest.mark.parametrize("a,b,expected", [
    ("ffffffffffffffff", "7fffffffffffffff", 0.015625),
    ("ffffffffffffffff", "0000000000000000", 1.0),
    ("8000000000000001", "00000000000000ff", 0.125),
    ("c8e0726f278ebbc6", "c8e0726f278ebbc6", 0.0),
])
def test_golden_distances(spark, a, b, expected):
    assert _dist(spark, a, b) == expected


def test_length_guard(spark):
    with pytest.raises(Exception, match="Hashes must have the same length"):
        _dist(spark, "ffffffffffffffff", "ffffffff")


def test_invalid_hex_raises(spark):
    with pytest.raises(Exception, match="invalid hex hash"):
        spark.range(1).select(hex_to_bits(F.lit("zz"))).collect()


def test_hex_roundtrip(spark):
    vals = ["0000000000000000", "8000000000000000", "ffffffffffffffff", "0123456789abcdef"]
    df = spark.createDataFrame([(v,) for v in vals], "h string")
    out = [r[0] for r in df.select(bits_to_hex(hex_to_bits("h"))).collect()]
    assert out == vals


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=2**64 - 1), min_size=3, max_size=3))
def test_distance_properties(spark, xs):
    hs = [format(x, "016x") for x in xs]
    d = {(i, j): _dist(spark, hs[i], hs[j]) for i in range(3) for j in range(3)}
    for i in range(3):
        assert d[(i, i)] == 0.0
        for j in range(3):
            assert d[(i, j)] == d[(j, i)] == bin(xs[i] ^ xs[j]).count("1") / 64
            for k in range(3):
                assert d[(i, k)] <= d[(i, j)] + d[(j, k)] + 1e-12
