"""Name -> implementation registries for image modifications and hashing methods.

Both are insertion-ordered; re-registering a name replaces the implementation
but keeps its place, so ids (1-based registration order) stay stable.  Each
entry has two forms of the same arithmetic:

* ``grid``: Column expressions over a grey grid ``(px ARRAY<INT>, width, height)``
  with sizes fixed per call — keeps table-of-grid plans JVM-side;
* ``raster``: a numpy function used inside the Arrow-batched raster job.

Users add methods with the decorators::

    @MODIFICATIONS.register("flip")
    class Flip:
        def grid(self, px, w, h): ...     # -> (px, w, h) Columns
        def size(self, w, h): ...         # -> output (w, h) for fixed input sizes
        def raster(self, arr): ...        # HxW[xC] uint8 -> HxW[xC] uint8
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.functions import grid as G
from imprint.functions import hashing as H
from imprint.functions.resample import resize_grid


class Registry:
    def __init__(self, kind: str):
        self.kind = kind
        self._items: dict[str, object] = {}

    def register(self, name: str):
        def deco(cls):
            self._items[name] = cls
            return cls

        return deco

    def names(self) -> list[str]:
        return list(self._items)

    def get(self, name: str):
        return self._items[name]()

    def items(self):
        return [(n, c()) for n, c in self._items.items()]

    def ids(self) -> dict[str, int]:
        return {n: i + 1 for i, n in enumerate(self._items)}

    def frame(self, spark: SparkSession) -> DataFrame:
        """The dimension table ``(id INT, name STRING)`` in registration order."""
        schema = T.StructType([T.StructField("id", T.IntegerType(), False),
                               T.StructField("name", T.StringType(), False)])
        return spark.createDataFrame([(i, n) for n, i in self.ids().items()], schema)


RAGGED_PIXELS = 1 << 20  # pixels that one call of a batch kernel holds, resized ones included
MODIFICATIONS = Registry("modification")
HASHING_METHODS = Registry("hashing method")


@MODIFICATIONS.register("base")
class Base:
    """Identity variant."""

    def grid(self, px, w, h):
        return px, w, h

    def size(self, w: int, h: int) -> tuple[int, int]:
        return w, h

    def raster(self, arr: np.ndarray) -> np.ndarray:
        return arr


@MODIFICATIONS.register("rotate_90")
class Rotate90:
    """90 degrees counter-clockwise; width and height swap."""

    def grid(self, px, w, h):
        return G.rotate90_ccw(px, w, h), h, w

    def size(self, w: int, h: int) -> tuple[int, int]:
        return h, w

    def raster(self, arr: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.rot90(arr, 1, axes=(0, 1)))


@HASHING_METHODS.register("averagehash")
class AverageHash:
    """Grey -> Lanczos to hash_size^2 -> bit = pixel >= mean."""

    def __init__(self, hash_size: int = 8):
        self.hash_size = hash_size

    def grid(self, px, w: int, h: int):
        s = self.hash_size
        return H.average_hash(resize_grid(px, w, h, s, s), s)

    def batch(self, grids: np.ndarray) -> np.ndarray:
        from imprint.operators.raster import average_bits_batch, resize_batch

        s = self.hash_size
        return average_bits_batch(resize_batch(grids, s, s))

    def raster(self, grey: np.ndarray) -> int:
        from imprint.operators.raster import resize_np

        small = resize_np(grey, self.hash_size, self.hash_size).astype(np.int64)
        flags = small.reshape(-1) * small.size >= small.sum()
        return _flags_to_int(flags)

    @property
    def nbits(self) -> int:
        return self.hash_size * self.hash_size


@HASHING_METHODS.register("dct-hash")
class DCTHash:
    """Grey -> Lanczos to 32x32 -> 2-D DCT-II -> top-left 8x8 -> bit = coefficient > median."""

    def __init__(self, hash_size: int = 8, highfreq_factor: int = 4):
        self.hash_size = hash_size
        self.side = hash_size * highfreq_factor

    def grid(self, px, w: int, h: int):
        s = self.side
        return H.dct_hash(resize_grid(px, w, h, s, s), self.hash_size, s)

    def batch(self, grids: np.ndarray) -> np.ndarray:
        from imprint.operators.raster import dct_bits_batch, resize_batch

        return dct_bits_batch(resize_batch(grids, self.side, self.side), self.hash_size)

    def raster(self, grey: np.ndarray) -> int:
        from imprint.operators.raster import dct_bits_np, resize_np

        return dct_bits_np(resize_np(grey, self.side, self.side), self.hash_size)

    @property
    def nbits(self) -> int:
        return self.hash_size * self.hash_size


def _flags_to_int(flags) -> int:
    v = 0
    for f in flags:
        v = (v << 1) | int(bool(f))
    return v


def to_signed64(v: int) -> int:
    return v - (1 << 64) if v >= (1 << 63) else v


def modification_frame(spark: SparkSession) -> DataFrame:
    return MODIFICATIONS.frame(spark)


def method_frame(spark: SparkSession) -> DataFrame:
    return HASHING_METHODS.frame(spark)


def grid_variants(images: DataFrame, width, height, px_col: str = "px",
                  limit: int | None = None, registry: Registry | None = None) -> DataFrame:
    """J1 fan-out in one pass: one row per (image, registered modification), Column form.

    The registry is a handful of entries, so the fan-out is an ``inline`` of a
    literal-sized array per row: no join, no shuffle, the grid is read once.
    ``width`` and ``height`` are numbers or Columns.  ``limit`` caps the variants per image in
    registry order (L3; default none).  ``registry``: other modifications than the global ones.
    """
    registry = registry or MODIFICATIONS
    size = [x if isinstance(x, Column) else F.lit(x) for x in (width, height)]
    structs = []
    for name, mod in registry.items()[:limit]:
        px, w, h = mod.grid(F.col(px_col), *size)
        structs.append(F.struct(
            F.lit(registry.ids()[name]).alias("modification_id"),
            px.alias("vpx"), w.cast("int").alias("vwidth"), h.cast("int").alias("vheight"),
        ))
    rest = [c for c in images.columns if c != px_col]
    return images.select(*rest, F.inline(F.array(*structs)))


def _grids_a_call(method, width: int, height: int) -> int:
    """Grids of a size that one call of a method's kernel takes, by the larger of their pixels and those it resizes to."""
    return max(1, RAGGED_PIXELS // max(width * height, getattr(method, "side", 1) ** 2, 1))


def batch_hash_udf(method, width: int, height: int):
    """Arrow-batched fingerprint of same-size grey grids: one numpy call per ``RAGGED_PIXELS`` of a batch of rows."""
    from imprint.operators.raster import flags_hex

    @F.pandas_udf("string")
    def run(px: pd.Series) -> pd.Series:
        if len(px) == 0:
            return pd.Series([], dtype=object)
        values, step, out = px.to_numpy(), _grids_a_call(method, width, height), []
        for a in range(0, len(values), step):
            grids = np.stack(values[a:a + step]).astype(np.int64).reshape(-1, height, width)
            out += flags_hex(method.batch(grids))
        return pd.Series(out)

    return run


def ragged_hash_udf(method):
    """Arrow-batched fingerprint of grey grids of any sizes ``(px, width, height)``: one numpy call per size in a batch."""
    from imprint.operators.raster import flags_hex

    @F.pandas_udf("string")
    def run(px: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = np.empty(len(px), dtype=object)
        size = width.to_numpy().astype(np.int64) << 32 | height.to_numpy().astype(np.int64)
        for one in np.unique(size):
            at = np.flatnonzero(size == one)
            w, h = int(one >> 32), int(one & 0xFFFFFFFF)
            step = _grids_a_call(method, w, h)
            for a in range(0, len(at), step):
                rows = at[a:a + step]
                grids = np.stack(px.to_numpy()[rows]).astype(np.int64).reshape(len(rows), h, w)
                out[rows] = flags_hex(method.batch(grids))
        return pd.Series(out)

    return run


def ragged_fingerprints(variants: DataFrame, px_col: str = "vpx", methods: Registry | None = None) -> DataFrame:
    """J2 fan-out for grids of any sizes (columns ``vwidth``/``vheight``), found at run time: nothing is listed.

    One row per (variant, hashing method); a grid whose pixels don't fit its size raises in the kernel.
    """
    methods = methods or HASHING_METHODS
    size = [F.col("vwidth"), F.col("vheight")]
    structs = [F.struct(F.lit(methods.ids()[name]).alias("hashing_method_id"),
                        ragged_hash_udf(method)(F.col(px_col), *size).alias("hash")) for name, method in methods.items()]
    rest = [c for c in variants.columns if c != px_col]
    return variants.select(*rest, F.inline(F.array(*structs)))


def grid_fingerprints(variants: DataFrame, sizes, px_col: str = "vpx", engine: str = "arrow") -> DataFrame:
    """J2 fan-out: one row per (variant, registered hashing method).

    ``sizes`` lists the (width, height) the variant grids can have (columns
    ``vwidth``/``vheight``); each size gets its own branch.  ``engine``:
    ``"arrow"`` runs the numpy batch kernels in a pandas UDF (dense matrix
    work, ~100x faster than interpreted lambdas); ``"column"`` keeps the
    identical arithmetic in built-in higher-order functions.
    """
    sizes = sorted(set(sizes))
    structs = []
    ids = HASHING_METHODS.ids()
    for name, method in HASHING_METHODS.items():
        def one(w, h):
            if engine == "column":
                return method.grid(F.col(px_col), w, h)
            return batch_hash_udf(method, w, h)(F.col(px_col))

        if len(sizes) == 1:
            expr = one(*sizes[0])
        else:
            expr = None
            for w, h in sizes:
                cond = (F.col("vwidth") == w) & (F.col("vheight") == h)
                expr = F.when(cond, one(w, h)) if expr is None else expr.when(cond, one(w, h))
        structs.append(F.struct(F.lit(ids[name]).alias("hashing_method_id"), expr.alias("hash")))
    rest = [c for c in variants.columns if c != px_col]
    return variants.select(*rest, F.inline(F.array(*structs)))
