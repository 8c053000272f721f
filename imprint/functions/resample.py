"""Lanczos (a=3) resampling of 8-bit grey grids, exact to the common fixed-point definition.

The filter is separable: a horizontal pass, then a vertical pass.  Per output
pixel the window is centred on ``(x + 0.5) * scale`` and widened by the scale
factor when shrinking; the double weights are normalised to sum 1, turned into
22-bit fixed point, and each pass rounds (``+ 2**21``), shifts and clips to
0..255.  Resizing to the same size is the identity (no pass runs).

:func:`coefficients` is shared by the Column form below (constant weights baked
into the plan) and the numpy form in :mod:`imprint.operators.raster`.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from imprint.functions.bits import _c, let

# Fixed values of the resampling definition.
LANCZOS_A = 3.0
PRECISION_BITS = 22  # 32 - 8 - 2


def _sinc(x: float) -> float:
    if x == 0.0:
        return 1.0
    x *= math.pi
    return math.sin(x) / x


def lanczos(x: float) -> float:
    if -LANCZOS_A <= x < LANCZOS_A:
        return _sinc(x) * _sinc(x / LANCZOS_A)
    return 0.0


@lru_cache(maxsize=None)
def coefficients(in_size: int, out_size: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """Per output index: (first input index, fixed-point weights)."""
    scale = in_size / out_size
    filterscale = max(scale, 1.0)
    support = LANCZOS_A * filterscale
    one = 1 << PRECISION_BITS
    out = []
    for xx in range(out_size):
        center = (xx + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), in_size)
        w = [lanczos((x + lo - center + 0.5) / filterscale) for x in range(hi - lo)]
        total = sum(w)
        if total != 0.0:
            w = [v / total for v in w]
        fixed = tuple(int(-0.5 + v * one) if v < 0 else int(0.5 + v * one) for v in w)
        out.append((lo, fixed))
    return tuple(out)


def padded(in_size: int, out_size: int) -> tuple[list[int], list[int], int]:
    """Coefficients as flat constant arrays: starts, weights (out_size x k, zero padded), k."""
    co = coefficients(in_size, out_size)
    k = max(len(w) for _, w in co)
    starts = [lo for lo, _ in co]
    weights = [v for _, w in co for v in (list(w) + [0] * (k - len(w)))]
    return starts, weights, k


def _clip8(acc: Column) -> Column:
    return F.least(F.greatest(F.shiftright(acc, PRECISION_BITS), F.lit(0)), F.lit(255)).cast("int")


def _pass(p: Column, n_lines: int, line_len: int, out_len: int, horizontal: bool) -> Column:
    """Resample every line of a row-major grid; output stays row-major."""
    starts, weights, k = padded(line_len, out_len)
    s_arr = F.array(*[F.lit(v) for v in starts])
    w_arr = F.array(*[F.lit(v) for v in weights])

    def out_px(i):
        if horizontal:  # output grid n_lines x out_len, i = line * out_len + o
            line, o = F.floor(i / out_len).cast("int"), (i % out_len).cast("int")
        else:  # output grid out_len x n_lines, i = o * n_lines + line
            o, line = F.floor(i / n_lines).cast("int"), (i % n_lines).cast("int")
        start = F.element_at(s_arr, o + 1)

        def src(t):
            pos = F.least(start + t, F.lit(line_len - 1))
            idx = line * line_len + pos if horizontal else pos * n_lines + line
            return F.element_at(p, idx + 1).cast("int")

        acc = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.lit(1 << (PRECISION_BITS - 1)),
            lambda a, t: a + F.element_at(w_arr, o * k + t + 1) * src(t),
        )
        return _clip8(acc)

    return F.transform(F.sequence(F.lit(0), F.lit(n_lines * out_len - 1)), out_px)


def resize_grid(px, width: int, height: int, out_width: int, out_height: int) -> Column:
    """Lanczos-resize a row-major ``height x width`` grey grid (sizes fixed per call)."""
    if (width, height) == (out_width, out_height):
        return _c(px)
    cur = _c(px)
    if out_width != width:
        cur = let(cur, lambda p: _pass(p, height, width, out_width, True))
    if out_height != height:
        cur = let(cur, lambda p: _pass(p, out_width, height, out_height, False))
    return cur
