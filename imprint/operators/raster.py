"""Raster jobs: decoded images -> variants -> digests -> fingerprints, Arrow-batched.

Spark's ``image`` source decodes files on the executors into
``image STRUCT<origin, height, width, nChannels, mode, data>`` with row-major
BGR(A) or grey bytes.  Everything per-pixel here is numpy inside
``mapInPandas`` (one raster decode per image, batches of rows per call); the
only shuffle of the chain is the digest dedup, which moves ids and digests,
never pixels.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.functions.hashing import dct_basis
from imprint.functions.resample import PRECISION_BITS, coefficients

# Channel count -> mode name that goes into the content digest.
MODE_NAMES = {1: "L", 3: "RGB", 4: "RGBA"}


def _weights(in_size: int, out_size: int) -> np.ndarray:
    """Dense (out, in) int64 weight matrix of the Lanczos filter."""
    mat = np.zeros((out_size, in_size), dtype=np.int64)
    for o, (lo, w) in enumerate(coefficients(in_size, out_size)):
        mat[o, lo: lo + len(w)] = w
    return mat


_WCACHE: dict[tuple[int, int], np.ndarray] = {}


def _w(in_size: int, out_size: int) -> np.ndarray:
    key = (in_size, out_size)
    if key not in _WCACHE:
        _WCACHE[key] = _weights(in_size, out_size)
    return _WCACHE[key]


def _clip8(acc: np.ndarray) -> np.ndarray:
    return np.clip(acc >> PRECISION_BITS, 0, 255)


def resize_np(grey: np.ndarray, out_w: int, out_h: int) -> np.ndarray:
    """Lanczos resize of an (H, W) uint8 grid: horizontal pass, then vertical, exact integers."""
    h, w = grey.shape
    cur = grey.astype(np.int64)
    half = 1 << (PRECISION_BITS - 1)
    if out_w != w:
        cur = _clip8(cur @ _w(w, out_w).T + half)
    if out_h != h:
        cur = _clip8(_w(h, out_h) @ cur + half)
    return cur.astype(np.uint8)


_BASIS: dict[tuple[int, int], np.ndarray] = {}


def dct_bits_np(grey: np.ndarray, keep: int = 8) -> int:
    """Fixed-point DCT hash bits (unsigned int) of a square grey grid; see functions.hashing."""
    side = grey.shape[0]
    key = (keep, side)
    if key not in _BASIS:
        _BASIS[key] = np.array(dct_basis(keep, side), dtype=np.int64).reshape(keep, side)
    b = _BASIS[key]
    coeffs = (b @ grey.astype(np.int64) @ b.T).reshape(-1)
    srt = np.sort(coeffs)
    n = coeffs.size
    lo, hi = srt[(n + 1) // 2 - 1], srt[n // 2]
    flags = coeffs * 2 > lo + hi
    v = 0
    for f in flags:
        v = (v << 1) | int(f)
    return v


def to_rgb(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    """Spark image bytes (BGR/BGRA/grey) -> (H, W[, C]) array in RGB(A) order."""
    arr = np.frombuffer(data, dtype=np.uint8)
    if c == 1:
        return arr.reshape(h, w)
    arr = arr.reshape(h, w, c)
    order = [2, 1, 0] if c == 3 else [2, 1, 0, 3]
    return arr[:, :, order]


def to_grey(rgb: np.ndarray) -> np.ndarray:
    """RGB(A) -> L with the fixed-point luma weights (alpha ignored); grey passes through."""
    if rgb.ndim == 2:
        return rgb
    x = rgb[:, :, :3].astype(np.int64)
    return ((x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 32768) >> 16).astype(np.uint8)


def bits_hex(bits: int, nbits: int) -> str:
    """A bit string as hex, most significant bit first: nbits // 4 digits, or one more where bits beyond need it."""
    return format(bits, f"0{nbits // 4}x")


def content_digest(pixels: np.ndarray) -> str:
    """blake2b over the raw pixel bytes (RGB order) followed by the mode name; size is not included."""
    c = 1 if pixels.ndim == 2 else pixels.shape[2]
    hsh = hashlib.blake2b(usedforsecurity=False)
    hsh.update(np.ascontiguousarray(pixels).tobytes())
    hsh.update(MODE_NAMES[c].encode())
    return hsh.hexdigest()


VARIANT_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType()),
    T.StructField("modification_id", T.IntegerType()),
    T.StructField("digest", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("n_channels", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
])


def raster_variants(images: DataFrame, image_col: str = "image", id_col: str = "image_id") -> DataFrame:
    """J1 + F1/F2 + F8 on rasters: every registered modification of every valid image, with its digest.

    ``data`` holds the variant's pixels in RGB(A)/L order (what the digest covers).
    """
    from imprint.operators.registry import MODIFICATIONS

    mods = [(MODIFICATIONS.ids()[n], m) for n, m in MODIFICATIONS.items()]
    src = images.where(F.col(f"{image_col}.height") > 0).select(
        F.col(id_col).cast("bigint").alias("image_id"),
        F.col(f"{image_col}.height").alias("h"), F.col(f"{image_col}.width").alias("w"),
        F.col(f"{image_col}.nChannels").alias("c"), F.col(f"{image_col}.data").alias("data"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for iid, h, w, c, data in zip(pdf.image_id, pdf.h, pdf.w, pdf.c, pdf.data):
                rgb = to_rgb(data, int(h), int(w), int(c))
                for mid, mod in mods:
                    v = mod.raster(rgb)
                    out.append((iid, mid, content_digest(v), v.shape[0], v.shape[1], int(c),
                                np.ascontiguousarray(v).tobytes()))
            yield pd.DataFrame(out, columns=[f.name for f in VARIANT_SCHEMA.fields])

    return src.mapInPandas(run, VARIANT_SCHEMA)


HASH_SCHEMA = T.StructType([
    T.StructField("modified_image_id", T.LongType()),
    T.StructField("hashing_method_id", T.IntegerType()),
    T.StructField("hash", T.StringType()),
])


def raster_fingerprints(variants: DataFrame, id_col: str = "modified_image_id") -> DataFrame:
    """J2 + F3-F7 on rasters: one hash per (variant, registered hashing method).

    The hash input is the variant forced to RGB then greyscale, as in the
    hashing stage; alpha is dropped, grey is replicated (which is the identity
    after the luma step).
    """
    from imprint.operators.registry import HASHING_METHODS

    methods = [(HASHING_METHODS.ids()[n], m) for n, m in HASHING_METHODS.items()]
    src = variants.select(F.col(id_col).cast("bigint").alias("modified_image_id"),
                          "height", "width", "n_channels", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for vid, h, w, c, data in zip(pdf.modified_image_id, pdf.height, pdf.width, pdf.n_channels, pdf.data):
                arr = np.frombuffer(data, dtype=np.uint8)
                arr = arr.reshape(int(h), int(w)) if int(c) == 1 else arr.reshape(int(h), int(w), int(c))
                grey = to_grey(arr)
                for mid, meth in methods:
                    bits = meth.raster(grey)
                    out.append((vid, mid, bits_hex(bits, meth.nbits)))
            yield pd.DataFrame(out, columns=["modified_image_id", "hashing_method_id", "hash"])

    return src.mapInPandas(run, HASH_SCHEMA)


CHAIN_FIELDS = [
    T.StructField("modification_id", T.IntegerType()),
    T.StructField("digest", T.StringType()),
    T.StructField("hashing_method_id", T.IntegerType()),
    T.StructField("hash", T.StringType()),
    T.StructField("valid", T.BooleanType()),
]


def raster_hashes(images: DataFrame, image_col: str = "image", keys: tuple[str, ...] = ("image_id",),
                  keep_invalid: bool = False, limit: int | None = None) -> DataFrame:
    """J1 + J2 fused: decode once, every modification, its digest, every hashing method.

    Output rows are narrow (``keys``, ids, digest, hash), so the first-writer
    dedup that follows shuffles no pixels.  Undecodable images (height -1)
    give one row with ``valid = false`` when ``keep_invalid``, else nothing.
    ``limit`` caps the variants per image in registry order (L3; default none).
    """
    from imprint.operators.registry import HASHING_METHODS, MODIFICATIONS

    mods = [(MODIFICATIONS.ids()[n], m) for n, m in MODIFICATIONS.items()][:limit]
    methods = [(HASHING_METHODS.ids()[n], m) for n, m in HASHING_METHODS.items()]
    src = images if keep_invalid else images.where(F.col(f"{image_col}.height") > 0)
    src = src.select(
        *keys,
        F.col(f"{image_col}.height").alias("_h"), F.col(f"{image_col}.width").alias("_w"),
        F.col(f"{image_col}.nChannels").alias("_c"), F.col(f"{image_col}.data").alias("_data"),
    )
    key_fields = [f for f in src.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + CHAIN_FIELDS)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec, h, w, c, data in zip(pdf[list(keys)].itertuples(index=False, name=None),
                                          pdf["_h"], pdf["_w"], pdf["_c"], pdf["_data"]):
                if h is None or int(h) <= 0:
                    out.append(rec + (None, None, None, None, False))
                    continue
                rgb = to_rgb(data, int(h), int(w), int(c))
                for mid, mod in mods:
                    v = mod.raster(rgb)
                    digest = content_digest(v)
                    grey = to_grey(v)
                    for hid, meth in methods:
                        out.append(rec + (mid, digest, hid, bits_hex(meth.raster(grey), meth.nbits), True))
            yield pd.DataFrame(out, columns=names)

    return src.mapInPandas(run, schema)


def from_bytes(data: bytes, h: int, w: int, c: int) -> np.ndarray:
    """Stored pixels (RGB(A) or grey order) -> (H, W[, C])."""
    arr = np.frombuffer(data, dtype=np.uint8)
    return arr.reshape(h, w) if c == 1 else arr.reshape(h, w, c)


PIXEL_FIELDS = [
    T.StructField("modification_id", T.IntegerType()),
    T.StructField("digest", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("n_channels", T.IntegerType()),
    T.StructField("hashes", T.ArrayType(T.StructType([T.StructField("hashing_method_id", T.IntegerType()),
                                                      T.StructField("hash", T.StringType())]))),
    T.StructField("data", T.BinaryType()),
    T.StructField("valid", T.BooleanType()),
]


def raster_pixels(images: DataFrame, image_col: str = "image", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """J1 + J2 + S4 in the one decode pass: per variant its digest, its hashes and its pixels.

    Meant to be written as it is: with the pixels in a column of their own, later steps read the narrow columns
    only, and no exchange ever carries ``data``.  An undecodable image gives one row with ``valid = false``.
    """
    from imprint.operators.registry import HASHING_METHODS, MODIFICATIONS

    mods = [(MODIFICATIONS.ids()[n], m) for n, m in MODIFICATIONS.items()]
    methods = [(HASHING_METHODS.ids()[n], m) for n, m in HASHING_METHODS.items()]
    src = images.select(*keys, F.col(f"{image_col}.height").alias("_h"), F.col(f"{image_col}.width").alias("_w"),
                        F.col(f"{image_col}.nChannels").alias("_c"), F.col(f"{image_col}.data").alias("_data"))
    schema = T.StructType([f for f in src.schema.fields if f.name in keys] + PIXEL_FIELDS)
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec, h, w, c, data in zip(pdf[list(keys)].itertuples(index=False, name=None),
                                          pdf["_h"], pdf["_w"], pdf["_c"], pdf["_data"]):
                if h is None or int(h) <= 0:
                    yield pd.DataFrame([rec + (None,) * 7 + (False,)], columns=names)
                    continue
                out = []
                rgb = to_rgb(data, int(h), int(w), int(c))
                for mid, mod in mods:
                    v = np.ascontiguousarray(mod.raster(rgb))
                    grey = to_grey(v)
                    found = [{"hashing_method_id": hid, "hash": bits_hex(m.raster(grey), m.nbits)} for hid, m in methods]
                    out.append(rec + (mid, content_digest(v), v.shape[0], v.shape[1], int(c), found, v.tobytes(), True))
                yield pd.DataFrame(out, columns=names)

    return src.mapInPandas(run, schema)


# ---- batch kernels: many same-size grids at once (N, H, W) -------------------------------------

def resize_batch(grids: np.ndarray, out_w: int, out_h: int) -> np.ndarray:
    """Lanczos resize of a stack of (H, W) grey grids, exact integers, same arithmetic as ``resize_np``."""
    n, h, w = grids.shape
    cur = grids.astype(np.int64)
    half = 1 << (PRECISION_BITS - 1)
    if out_w != w:
        cur = _clip8(np.matmul(cur, _w(w, out_w).T) + half)
    if out_h != h:
        cur = _clip8(np.matmul(_w(h, out_h), cur) + half)
    return cur


def flags_hex(flags: np.ndarray) -> list[str]:
    """(N, nbits) booleans, MSB first -> hex strings."""
    n = flags.shape[1]
    pad = (-n) % 8
    packed = np.packbits(flags.astype(np.uint8), axis=1)
    return [bits_hex(int.from_bytes(row.tobytes(), "big") >> pad, n) for row in packed]


def average_bits_batch(grids: np.ndarray) -> np.ndarray:
    """(N, H, W) -> (N, H*W) flags: pixel * n >= sum."""
    flat = grids.reshape(grids.shape[0], -1).astype(np.int64)
    return flat * flat.shape[1] >= flat.sum(axis=1, keepdims=True)


def dct_bits_batch(grids: np.ndarray, keep: int = 8) -> np.ndarray:
    side = grids.shape[1]
    key = (keep, side)
    if key not in _BASIS:
        _BASIS[key] = np.array(dct_basis(keep, side), dtype=np.int64).reshape(keep, side)
    b = _BASIS[key]
    coeffs = np.matmul(np.matmul(b, grids.astype(np.int64)), b.T).reshape(grids.shape[0], -1)
    srt = np.sort(coeffs, axis=1)
    n = coeffs.shape[1]
    lo, hi = srt[:, (n + 1) // 2 - 1: (n + 1) // 2], srt[:, n // 2: n // 2 + 1]
    return coeffs * 2 > lo + hi
