"""Perceptual fingerprints of grey grids, as Spark Column expressions.

Both functions take a grid that already has the hashing resolution (8x8 for the
average hash, 32x32 for the DCT hash); the raster job in
:mod:`imprint.operators.raster` does greyscale + Lanczos resampling first.

* average hash: bit = pixel >= mean, row-major, MSB first.  The mean test is
  done in integers (``pixel * n >= sum``), so there is no rounding.
* DCT hash: 2-D DCT-II of the 32x32 grid, top-left 8x8 coefficients,
  bit = coefficient > median of those 64.  The cosine basis is fixed-point
  (``round(cos * 2**20)``) so that all arithmetic is exact 64-bit integer maths:
  a uniform image gets exactly-zero AC terms, where a float product leaves
  +-1e-14 noise that flips ``>`` on near-ties.  Bits only differ from a float
  implementation on such near-ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from imprint.functions.bits import bits_to_hex, bool_array_to_bits, bool_array_to_hex, let

DCT_SIDE = 32  # hash_size * highfreq_factor (8 * 4)
DCT_KEEP = 8  # low-frequency block kept
DCT_SCALE_BITS = 20


def dct_basis(keep: int = DCT_KEEP, side: int = DCT_SIDE, scale_bits: int = DCT_SCALE_BITS) -> list[int]:
    """Row-major ``keep x side`` integer DCT-II basis: round(cos(pi*u*(2y+1)/(2*side)) * 2**scale_bits)."""
    s = 1 << scale_bits
    return [
        int(round(math.cos(math.pi * u * (2 * y + 1) / (2 * side)) * s))
        for u in range(keep)
        for y in range(side)
    ]


def average_hash_flags(px) -> Column:
    """ARRAY<BOOLEAN>: pixel * n >= sum(pixels), row-major."""

    def body(p):
        n = F.size(p).cast("bigint")
        return let(
            F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x),
            lambda total: F.transform(p, lambda x: x.cast("bigint") * n >= total),
        )

    return let(px, body)


def average_hash_bits(px) -> Column:
    """BIGINT fingerprint of a grey grid (<= 64 pixels)."""
    return bool_array_to_bits(average_hash_flags(px))


def flags_to_hex(flags, nbits: int) -> Column:
    """Hex of a flag array: via one BIGINT up to 64 bits, nibble by nibble beyond."""
    if nbits <= 64:
        return bits_to_hex(bool_array_to_bits(flags), nbits)
    return bool_array_to_hex(flags, nbits)


def average_hash(px, hash_size: int = 8) -> Column:
    """Lower-case hex average hash of a ``hash_size`` x ``hash_size`` grey grid."""
    return flags_to_hex(average_hash_flags(px), hash_size * hash_size)


def _dct_rows(p: Column, basis: Column, keep: int, side: int) -> Column:
    """First pass, ``keep x side``: R[u][x] = sum_y B[u][y] * P[y][x]."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(keep * side - 1)),
        lambda k: F.aggregate(
            F.sequence(F.lit(0), F.lit(side - 1)),
            F.lit(0).cast("bigint"),
            lambda acc, y: acc
            + F.element_at(basis, F.floor(k / side).cast("int") * side + y + 1)
            * F.element_at(p, y * side + (k % side) + 1).cast("bigint"),
        ),
    )


def _dct_cols(r: Column, basis: Column, keep: int, side: int) -> Column:
    """Second pass, ``keep x keep``: D[u][v] = sum_x R[u][x] * B[v][x]."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(keep * keep - 1)),
        lambda k: F.aggregate(
            F.sequence(F.lit(0), F.lit(side - 1)),
            F.lit(0).cast("bigint"),
            lambda acc, x: acc
            + F.element_at(r, F.floor(k / keep).cast("int") * side + x + 1)
            * F.element_at(basis, (k % keep) * side + x + 1),
        ),
    )


def dct_coefficients(px, keep: int = DCT_KEEP, side: int = DCT_SIDE) -> Column:
    """Low-frequency ``keep x keep`` block of the 2-D DCT-II (fixed-point BIGINT) of a side x side grid."""
    basis = F.array(*[F.lit(v).cast("bigint") for v in dct_basis(keep, side)])
    return let(px, lambda p: let(_dct_rows(p, basis, keep, side), lambda r: _dct_cols(r, basis, keep, side)))


def median_threshold_flags(coeffs) -> Column:
    """Flag = coefficient > median, with the median of an even count = mean of the two middles.

    Compared as ``2 * c > m1 + m2`` so it stays in integers.
    """

    def body(c):
        return let(F.array_sort(c), lambda srt: F.transform(
            c,
            lambda x: x * 2 > F.element_at(srt, F.floor((F.size(c) + 1) / 2).cast("int"))
            + F.element_at(srt, F.floor(F.size(c) / 2).cast("int") + 1),
        ))

    return let(coeffs, body)


def median_threshold_bits(coeffs) -> Column:
    return bool_array_to_bits(median_threshold_flags(coeffs))


def dct_hash_bits(px, keep: int = DCT_KEEP, side: int = DCT_SIDE) -> Column:
    """BIGINT DCT fingerprint of a ``side x side`` grey grid (keep <= 8)."""
    return median_threshold_bits(dct_coefficients(px, keep, side))


def dct_hash(px, hash_size: int = DCT_KEEP, side: int = DCT_SIDE) -> Column:
    """Lower-case hex DCT hash of a ``side x side`` grey grid."""
    return flags_to_hex(median_threshold_flags(dct_coefficients(px, hash_size, side)), hash_size * hash_size)
