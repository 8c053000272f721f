"""What the pairs of one block pair amount to: counts, near pairs, nearest others, in numpy tiles that fit the cache.

A group is one block pair of hashes of up to 64 bits: a key that ends in the numbers of the two blocks, and columns
``id``, ``bits``, ``role`` (0: left block, 1: right block; a block with itself has role 0 only).  Its pairs are those of
its rows, each once, without pairs of one id; rows without id take no part.  XOR and popcount run over tiles of ``TILE`` pairs, so a group takes memory for its rows
(bounded by the block) and one tile, never for its pairs; what is found leaves in batches of about ``OUT_ROWS``.

Rows of one id have to be in one block (blocks are dealt by a hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TILE = (64, 4096)  # 2 MB of XORs and 256 KB of distances
OUT_ROWS = 1 << 17
SAME = 255  # stands for the distance where a tile's cell is no pair
ID_BITS = 56

HIST_SCHEMA = "hashing_method_id int, same_image boolean, distance_bits int, pairs long"
NEAREST_SCHEMA = "hash_id long, k long"
NEAR_SCHEMA = "hash_id1 long, hash_id2 long, distance_bits int, m {}"  # the method's own type


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _side(table: pa.Table) -> pa.Table:
    """The rows with an id, ascending by id."""
    return table.filter(table.column("id").is_valid()).sort_by("id").combine_chunks()


def _bits(table: pa.Table) -> np.ndarray:
    return _column(table, "bits").astype(np.int64, copy=False).view(np.uint64)


def sides(key, table: pa.Table) -> tuple[pa.Table, pa.Table | None]:
    """Left and right block of a group; right is None for a block with itself."""
    role = _column(table, "role")
    left = _side(table.filter(pa.array(role == 0)))
    return left, (None if key[-2].as_py() == key[-1].as_py() else _side(table.filter(pa.array(role == 1))))


def tiles(lid: np.ndarray, left: np.ndarray, rid: np.ndarray, right: np.ndarray,
          triangle: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first row, first column, distances)`` of the tiles that cover the pairs of ``left`` and ``right``.

    ``triangle``: both are the same rows, ascending by id; cells whose row's id isn't below the column's hold ``SAME``.
    The array is used again for the next tile.
    """
    xor, dist = np.empty(TILE[0] * TILE[1], np.uint64), np.empty(TILE[0] * TILE[1] + 1, np.uint8)
    for a in range(0, len(left), TILE[0]):
        rows = left[a : a + TILE[0], None]
        for c in range(a if triangle else 0, len(right), TILE[1]):
            cols = right[None, c : c + TILE[1]]
            shape = (rows.shape[0], cols.shape[1])
            x, d = xor[: shape[0] * shape[1]].reshape(shape), dist[: shape[0] * shape[1]].reshape(shape)
            np.bitwise_xor(rows, cols, out=x)
            np.bitwise_count(x, out=d)
            if triangle:
                ids = lid[a : a + shape[0]]
                w = int(np.searchsorted(rid[c : c + shape[1]], ids[-1], side="right"))  # the columns beyond are later
                if w:
                    d[:, :w][ids[:, None] >= rid[None, c : c + w]] = SAME
            yield a, c, d


def _pair(left: pa.Table, right: pa.Table | None):
    lid, lb = _column(left, "id"), _bits(left)
    return (lid, lb, lid, lb, True) if right is None else (lid, lb, _column(right, "id"), _bits(right), False)


def _count(pair) -> np.ndarray:
    """Pairs by distance."""
    two = np.zeros(1 << 16, np.int64)  # two neighbouring distances are counted as one number
    odd = np.zeros(1 << 8, np.int64)
    for _, _, d in tiles(*pair):
        flat = d.reshape(-1)
        n = len(flat) // 2
        found = np.bincount(flat[: 2 * n].view(np.uint16))
        two[: len(found)] += found
        if len(flat) % 2:
            odd[flat[-1]] += 1
    two = two.reshape(256, 256)
    return (two.sum(axis=0) + two.sum(axis=1) + odd)[:65]


def _count_alike(left: pa.Table, right: pa.Table | None, pair, by: str, most: int = 1 << 20) -> np.ndarray:
    """Pairs by distance whose two rows agree in column ``by`` (null agrees with none)."""
    lid, lb, rid, rb, triangle = pair
    lv, rv = left.column(by), (left if right is None else right).column(by)
    li, ri = (np.flatnonzero(v.is_valid().to_numpy()) for v in (lv, rv))
    x, y = (v.drop_null().to_numpy() for v in (lv, rv))
    order = np.argsort(y, kind="stable")
    y, ri = y[order], ri[order]
    lo = np.searchsorted(y, x, side="left")
    n = np.searchsorted(y, x, side="right") - lo
    counts, ends = np.zeros(65, np.int64), np.cumsum(n)
    a = 0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        m = n[a:b]
        first = np.repeat(li[a:b], m)
        second = ri[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        if triangle:
            ok = lid[first] < rid[second]
            first, second = first[ok], second[ok]
        counts += np.bincount(np.bitwise_count(lb[first] ^ rb[second]), minlength=65)
        a = b
    return counts


def _histogram(m, left: pa.Table, right: pa.Table | None, by: str) -> pa.Table:
    pair = _pair(left, right)
    alike = _count_alike(left, right, pair, by)
    counts = np.concatenate([_count(pair) - alike, alike])
    at = np.flatnonzero(counts)
    return pa.table({"hashing_method_id": pa.array([m] * len(at), pa.int32()), "same_image": at >= 65,
                     "distance_bits": (at % 65).astype(np.int32), "pairs": counts[at]})


def histogram(by: str = "image_id"):
    """Group ``(method, ...)`` -> its pairs counted by (agree in ``by``?, distance)."""
    def run(key, table):
        return _histogram(key[0].as_py(), *sides(key, table), by)
    return run


def histogram_joined(by: str = "image_id"):
    """As :func:`histogram`, of the left and the right side of a block pair ``(method, bi, bj)``, joined."""
    def run(key, left, right):
        m, bi, bj = (k.as_py() for k in key)
        return _histogram(m, _side(left), None if bi == bj else _side(right), by)
    return run


def _nearest(pair) -> tuple[np.ndarray, np.ndarray]:
    """Of every row and column the least ``distance << ID_BITS | id`` of its pairs (the largest number: none)."""
    lid, lb, rid, rb, triangle = pair
    none = np.iinfo(np.int64).max
    dl, kl = np.full(len(lid), SAME, np.uint8), np.full(len(lid), none, np.int64)
    dr, kr = (dl, kl) if triangle else (np.full(len(rid), SAME, np.uint8), np.full(len(rid), none, np.int64))
    # ids ascend, and so do the others that a row meets: a later one has to be nearer
    for a, c, d in tiles(*pair):
        for best, keys, at, other, start, axis in ((dr, kr, c, lid, a, 0), (dl, kl, a, rid, c, 1)):
            least = d.min(axis=axis)
            better = np.flatnonzero(least < best[at : at + len(least)])
            if len(better):
                who = (d[:, better] if axis == 0 else d[better]).argmin(axis=axis)
                best[at + better] = least[better]
                keys[at + better] = least[better].astype(np.int64) << ID_BITS | other[start + who]
    return kl, kr


def nearest(key, table):
    """Each row's least ``distance << 56 | id`` in its group."""
    left, right = sides(key, table)
    pair = _pair(left, right)
    kl, kr = _nearest(pair)
    ids, keys = (pair[0], kl) if right is None else (np.concatenate([pair[0], pair[2]]), np.concatenate([kl, kr]))
    ok = keys != np.iinfo(np.int64).max
    return pa.table({"hash_id": ids[ok], "k": keys[ok]})


def _met(lv: np.ndarray, rv: np.ndarray, masks: np.ndarray, width: int, most: int = 1 << 20):
    """``(i, j)`` of all cells with ``lv[i] ^ rv[j]`` in ``masks``, in parts of about ``most``; no other cell is met."""
    order = np.argsort(rv, kind="stable")
    rv = rv[order]
    dense = width <= 20
    if dense:
        ends = np.cumsum(np.bincount(rv.astype(np.int64), minlength=1 << width))
    step = max(1, most // len(masks))
    for a in range(0, len(lv), step):
        probe = (lv[a : a + step, None] ^ masks[None]).reshape(-1)
        if dense:
            probe = probe.astype(np.int64)
            last, first = ends[probe], np.where(probe > 0, ends[probe - 1], 0)
        else:
            first, last = np.searchsorted(rv, probe, side="left"), np.searchsorted(rv, probe, side="right")
        at = np.flatnonzero(last > first)
        first, n, row = first[at], (last - first)[at], at // len(masks) + a
        done, b = np.cumsum(n), 0
        while b < len(at):
            c = max(b + 1, int(np.searchsorted(done, (done[b - 1] if b else 0) + most, side="right")))
            m = n[b:c]
            yield np.repeat(row[b:c], m), order[np.repeat(first[b:c] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            b = c


def near_probed(threshold: int, layout, masks):
    """Group ``(method, ...)`` -> its pairs within ``threshold`` bits, by probes around the values of bands.

    ``layout``: (lowest bit, width, radius) of each band; ``masks``: those that a hash's value of the band is probed
    with.  Rows that don't meet in a band are never compared, and a pair is kept from the first band within its radius.
    """
    masks = [np.array(m, np.uint64) for m in masks]

    def value(x, low, width):
        return (x >> np.uint64(low)) & np.uint64((1 << width) - 1)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lid, lb, rid, rb, triangle = _pair(*sides(key, pa.Table.from_batches(list(batches))))

        def found():
            for band, (low, width, _) in enumerate(layout):
                for i, j in _met(value(lb, low, width), value(rb, low, width), masks[band], width):
                    apart = lb[i] ^ rb[j]
                    dist = np.bitwise_count(apart)
                    ok = dist <= threshold
                    if triangle:
                        ok &= lid[i] < rid[j]
                    ok = np.flatnonzero(ok)
                    for lo, w, radius in layout[:band]:
                        ok = ok[np.bitwise_count(value(apart[ok], lo, w)) > radius]
                    yield lid[i[ok]], rid[j[ok]], dist[ok]
        yield from _near_batches(key, found())
    return run


def _near_batches(key, found) -> Iterator[pa.RecordBatch]:
    """Parts ``(ids, other ids, distances)`` as batches of about ``OUT_ROWS`` pairs."""
    held, size = [], 0

    def out():
        one, two, dist = (np.concatenate(x) for x in zip(*held))
        return pa.record_batch({"hash_id1": np.minimum(one, two), "hash_id2": np.maximum(one, two),
                                "distance_bits": dist.astype(np.int32),
                                "m": pa.array([key[0].as_py()] * len(one), key[0].type)})

    for part in found:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= OUT_ROWS:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def near(threshold: int, band_of=None):
    """Group ``(method, ...)`` -> its pairs (lesser id, greater id, distance) within ``threshold`` bits.

    ``band_of(xor)`` says which of several groups that a pair meets in is to keep it: the one whose key has that band
    in second place.
    """
    threshold = min(threshold, 64)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*sides(key, pa.Table.from_batches(list(batches))))
        lid, lb, rid, rb, _ = pair

        def found():
            for a, c, d in tiles(*pair):
                if not (d <= threshold).any():
                    continue
                i, j = np.nonzero(d <= threshold)
                dist, i, j = d[i, j], i + a, j + c
                if band_of is not None:
                    ok = band_of(lb[i] ^ rb[j]) == key[1].as_py()
                    i, j, dist = i[ok], j[ok], dist[ok]
                yield lid[i], rid[j], dist
        yield from _near_batches(key, found())
    return run
