"""Grey pixel grids as Spark columns: ``ARRAY<INT>`` in row-major order plus width/height.

These are the column-level counterparts of the raster jobs in
:mod:`imprint.operators.raster`: same arithmetic, but expressed with built-in
higher-order functions so a plan over a table of grids stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.functions.bits import _c, let

# ITU-R 601-2 luma weights in 16-bit fixed point, as used by the
# common "RGB -> L" conversion (L = (19595 R + 38470 G + 7471 B + 32768) >> 16).
LUMA_R, LUMA_G, LUMA_B, LUMA_ROUND = 19595, 38470, 7471, 32768


def value_to_pixel(v) -> Column:
    """Float in about [-0.5, 0.5] -> grey level 0..255: clip(floor((v + 0.5) * 255), 0, 255)."""
    scaled = F.floor((_c(v).cast("double") + F.lit(0.5)) * F.lit(255.0))
    return F.least(F.greatest(scaled, F.lit(0)), F.lit(255)).cast("int")


def embedding_to_grid(embedding) -> Column:
    """``ARRAY<FLOAT>`` -> ``ARRAY<INT>`` grey levels, element by element."""
    return F.transform(_c(embedding), value_to_pixel)


def luma(r, g, b) -> Column:
    """Integer greyscale of one RGB pixel (exact fixed-point formula above)."""
    acc = _c(r).cast("int") * LUMA_R + _c(g).cast("int") * LUMA_G + _c(b).cast("int") * LUMA_B + LUMA_ROUND
    return F.shiftright(acc, 16)


def greyscale_interleaved(values, channels: int = 3) -> Column:
    """Interleaved ``[r0,g0,b0,r1,...]`` -> grey per pixel; trailing partial pixels are dropped.

    ``channels`` of 1 returns the input; 4 (RGBA) ignores alpha, like an RGB conversion.
    """
    if channels == 1:
        return _c(values)
    return let(values, lambda arr: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(arr) / F.lit(channels)).cast("int") - 1),
        lambda k: luma(
            F.element_at(arr, k * channels + 1),
            F.element_at(arr, k * channels + 2),
            F.element_at(arr, k * channels + 3),
        ),
    ))


def rotate90_ccw(px, width, height) -> Column:
    """Rotate a row-major H x W grid by 90 degrees counter-clockwise (result is W x H).

    Output index k (row k div H, column k mod H) reads input (k mod H, W - 1 - k div H).
    """
    w, h = _c(width), _c(height)
    return let(px, lambda p: F.transform(
        F.sequence(F.lit(0), w * h - 1),
        lambda k: F.element_at(p, (k % h) * w + (w - 1 - F.floor(k / h).cast("int")) + 1),
    ))


def tile_grids(df: DataFrame, id_col: str, px_col: str, tiles_per_side: int = 4,
               tile_side: int = 8, out_id: str = "image_id") -> DataFrame:
    """Assemble square tiles into bigger grids: tile t of image i is row ``id = i * T*T + t``.

    Tiles sit row-major in a ``tiles_per_side`` square; a missing tile is black, so no row
    is left out.  Each group holds at most T*T small rows, so the aggregation is bounded.
    """
    per = tiles_per_side * tiles_per_side
    side = tiles_per_side * tile_side
    black = F.array_repeat(F.lit(0), tile_side * tile_side)
    grouped = (
        df.select(
            F.floor(F.col(id_col) / per).cast("bigint").alias(out_id),
            (F.col(id_col) % per).cast("int").alias("_t"),
            F.col(px_col).alias("_px"),
        )
        .groupBy(out_id)
        .agg(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda t: F.coalesce(
            F.get(F.filter(F.array_sort(F.collect_list(F.struct("_t", "_px"))), lambda x: x.getField("_t") == t),
                  F.lit(0)).getField("_px"), black)).alias("_tiles"))
        .where(F.size("_tiles") == per)  # always true: keeps the tiles from being inlined for each pixel below
    )

    def pixel(k):
        y = F.floor(k / side).cast("int")
        x = (k % side).cast("int")
        t = F.floor(y / tile_side).cast("int") * tiles_per_side + F.floor(x / tile_side).cast("int")
        pos = (y % tile_side) * tile_side + (x % tile_side)
        return F.element_at(F.element_at(F.col("_tiles"), t + 1), pos + 1)

    return grouped.select(
        out_id,
        F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel).alias("px"),
        F.lit(side).alias("width"),
        F.lit(side).alias("height"),
    )
