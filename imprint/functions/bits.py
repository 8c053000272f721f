"""Bit-string helpers as Spark Column expressions (all JVM-side, codegen where Spark allows).

A fingerprint is stored twice: as the fixed-width lower-case hex string the
result tables expose (``hash``), and as a signed 64-bit integer (``bits``) that
the pair join XORs.  ``conv(.., 16, -10)`` keeps the top bit as the sign, so
``bit_count(a ^ b)`` counts differing bits exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX16 = r"^[0-9a-f]{1,16}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst collapses projections into lambda bodies, so an array column used
    inside ``transform``/``aggregate`` would otherwise be recomputed for every
    element.  A one-step ``aggregate`` binds it like a ``let``.
    """
    return F.aggregate(F.array(F.lit(0)), _c(value), lambda acc, _x: acc, body)


def bits_to_hex(bits, nbits: int = 64) -> Column:
    """Integer bit vector -> lower-case hex, MSB first, zero padded to nbits // 4 digits.

    Where nbits is no multiple of 4, bits beyond these digits make the string one digit longer if they are set.
    """
    width = nbits // 4
    h = F.lower(F.hex(_c(bits)))
    return F.when(F.length(h) >= width, h).otherwise(F.lpad(h, width, "0"))


def bool_array_to_bits(flags) -> Column:
    """ARRAY<BOOLEAN> (row-major, first element = most significant) -> BIGINT."""
    flags = _c(flags)
    return F.aggregate(
        flags,
        F.lit(0).cast("bigint"),
        lambda acc, b: F.when(b, F.shiftleft(acc, 1).bitwiseOR(F.lit(1).cast("bigint"))).otherwise(
            F.shiftleft(acc, 1)
        ),
    )


HEX_DIGITS = "0123456789abcdef"


def bool_array_to_hex(flags, nbits: int | None = None) -> Column:
    """ARRAY<BOOLEAN> (first = most significant) -> lower-case hex, of ``nbits`` flags (any, but named, if no multiple of 4).

    Zero padded to nbits // 4 digits, and one digit longer if bits beyond these are set.
    """
    if nbits is not None and nbits % 4:
        padded = F.concat(F.array_repeat(F.lit(False), 4 - nbits % 4), _c(flags))
        return F.regexp_replace(bool_array_to_hex(padded), "^0", "")

    def nib(f, j):
        v = F.lit(0)
        for i, w in enumerate((8, 4, 2, 1)):
            v = v + F.element_at(f, j * 4 + i + 1).cast("int") * w
        return F.substring(F.lit(HEX_DIGITS), 1, 16).substr(v + 1, F.lit(1))

    return let(flags, lambda f: F.array_join(
        F.transform(F.sequence(F.lit(0), F.floor(F.size(f) / 4).cast("int") - 1), lambda j: nib(f, j)), ""))


def hex_to_words(hash_col) -> Column:
    """Hex fingerprint of any length -> ARRAY<BIGINT> of 16-digit chunks (the last may be shorter).

    Two hashes of the same length chunk identically, so XOR word by word counts differing bits.
    """
    h = _c(hash_col)
    checked = F.when(h.rlike(r"^[0-9a-f]+$"), h).otherwise(
        F.raise_error(F.concat(F.lit("invalid hex hash: "), F.coalesce(h, F.lit("NULL")))))
    return let(checked, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 16).cast("int")),
        lambda k: F.conv(F.substr(x, k * 16 + 1, F.lit(16)), 16, -10).cast("bigint")))


def words_bit_count(w1, w2) -> Column:
    """Number of differing bits between two word arrays of equal length."""
    return F.aggregate(F.zip_with(_c(w1), _c(w2), lambda a, b: F.bit_count(a.bitwiseXOR(b))),
                       F.lit(0), lambda acc, x: acc + x)


def hex_to_bits(hash_col) -> Column:
    """Hex fingerprint (up to 16 digits) -> BIGINT; invalid hex raises instead of giving 0."""
    h = _c(hash_col)
    checked = F.when(h.rlike(HEX16), h).otherwise(
        F.raise_error(F.concat(F.lit("invalid hex hash: "), F.coalesce(h, F.lit("NULL"))))
    )
    return F.conv(checked, 16, -10).cast("bigint")


def hamming_distance(bits1, bits2, nbits=64) -> Column:
    """Normalised Hamming distance popcount(a XOR b) / nbits, a double in [0, 1]."""
    n = nbits if isinstance(nbits, Column) else F.lit(float(nbits))
    return F.bit_count(_c(bits1).bitwiseXOR(_c(bits2))) / n.cast("double")


def hex_hamming_distance(hash1, hash2) -> Column:
    """Distance straight from two hex strings, with the equal-length guard.

    Used for ad-hoc comparisons; the pair join works on pre-parsed ``bits``.
    """
    h1, h2 = _c(hash1), _c(hash2)
    same = F.when(
        F.length(h1) == F.length(h2), F.length(h1) * 4
    ).otherwise(F.raise_error(F.lit("Hashes must have the same length")))
    return hamming_distance(hex_to_bits(h1), hex_to_bits(h2), same)


def assert_equal_lengths(hashes_df, method_col: str = "hashing_method_id", hash_col: str = "hash",
                         id_col: str | None = None):
    """One check per method (not per pair): every hash of a method has the same length.

    Returns a tiny DataFrame ``(method, nbits)``; evaluating it raises
    "Hashes must have the same length" if a method mixes lengths.
    """
    agg = hashes_df.groupBy(method_col).agg(
        F.min(F.length(hash_col)).alias("_lo"), F.max(F.length(hash_col)).alias("_hi"),
        F.count(F.lit(1)).alias("n"),
        *([F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id")] if id_col else []),
    )
    return agg.select(
        method_col,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") * 4)
        .otherwise(F.raise_error(F.lit("Hashes must have the same length")))
        .alias("nbits"),
        "n",
        *(["min_id", "max_id"] if id_col else []),
    )
