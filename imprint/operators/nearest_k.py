"""The k nearest other hashes of every hash: pivot cells, triangle-inequality pruning, bounded k-best merges.

Hamming distance is a metric, so for a pivot hash p the distance of a hash to any member of a cell is at least
the gap between its own distance to p and the cell's range of distances to p.

1. ``PIVOTS`` pivots per method, each the farthest from those before it among the ``SAMPLE`` hashes of smallest
   digest (a bounded sample; pivots decide how much is skipped, never the result).  A hash belongs to the cell of
   its nearest pivot; a large cell is cut into blocks, small ones next to each other share one.  Per cell and pivot the
   least and the greatest distance are kept: PIVOTS^2 numbers a method, on the driver and in the tasks.
2. Every hash searches one block of its own cell: its k-th best distance there bounds the search.
3. It is then sent to the other blocks with cells whose gap doesn't exceed that bound (an equal distance
   counts: ties go to the smaller id).  A group is one block with some of its visitors and gives at most k rows a
   visitor, within its bound.
4. One aggregate merges a hash's groups and keeps k.

Inside a group (:class:`_Search`) visitors meet rows by bands of their bits: rows that differ from the visitor in few bits
of a band come first, and a visitor is done once no row that it hasn't met can be among its k best.  Blocks are large
(``BLOCK``), since the share of pairs that is met falls as k-th best distances do.  Where bands cost more than comparing
every row (small groups, hashes that agree in most bands), every row is compared.

The share of pairs that bands and step 3 skip comes with :func:`search`.  Hashes have up to 64 bits (one width a method)
and ids in [0, 2^56), so distance and id travel as one BIGINT.  Repeated rows are candidates each; a hash is
never its own neighbour, nor is a row of the same id.  Fewer than k others: all of them.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.functions.bits import assert_equal_lengths, hex_to_bits
from imprint.session import materialise

PIVOTS = 32
SAMPLE = 2048  # hashes a method that reach the driver
BLOCK = 1 << 19  # most rows of a block; its task holds about 100 bytes a row
CELL = 1024  # rows of a cell, about, from which a method gets all its pivots
VISITORS = 1 << 18  # of a group, about; parallel tasks come from the visitors
DEALT = 32  # partitions a slot that groups are dealt to: hardly two meet in one
CELLS = 1 << 18  # distances held at once: they stay in the cache
FIRST = 2048  # columns whose k-th best bounds a hash's search in a block; with at least k of them
NONE = 254  # stands for no limit; 255 for the distance to a row of the same id
HELD = 1 << 22  # neighbours found that are held before they are cut to k a visitor
BANDED_FROM = 1 << 27  # pairs of a group from which bands are worth their sorting
TILE_COST = 30_000  # pairs that could be compared in the time that a tile takes besides
RING_WORK = 1 << 23  # values x masks of a ring, at most
ID_BITS = 56


@dataclass
class Found:
    neighbours: DataFrame  # hash_id, rank, neighbour_id, distance_bits
    pairs: int  # (hash, other hash) of all methods
    compared: int  # of them, those that a kernel compared (once a band that they were met in)

    @property
    def skipped(self) -> float:
        return 1 - self.compared / self.pairs if self.pairs else 0.0


def far_apart(bits: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unlike hashes, each the farthest from those before it."""
    taken = []
    far = np.full(len(bits), 65, np.int64)
    while len(taken) < n and len(bits):
        i = int(far.argmax())
        if not far[i]:
            break
        taken.append(bits[i])
        far = np.minimum(far, np.bitwise_count(bits ^ bits[i]))
    return np.array(taken, np.uint64)


class _Tiles:
    """Cells of visitors x rows whose distance is within each visitor's limit, by tiles that fit the cache."""

    def __init__(self):
        self.xor, self.dist, self.hit = np.empty(CELLS, np.uint64), np.empty(CELLS, np.uint8), np.zeros(CELLS + 8, bool)

    def within(self, q: np.ndarray, x: np.ndarray, limit: np.ndarray):
        wide = max(1, min(len(x), CELLS // 16))
        tall = max(1, CELLS // wide)
        for c in range(0, len(x), wide):
            cols = x[None, c : c + wide]
            for a in range(0, len(q), tall):
                rows = q[a : a + tall, None]
                shape = (rows.shape[0], cols.shape[1])
                size = shape[0] * shape[1]
                xor, dist = self.xor[:size].reshape(shape), self.dist[:size].reshape(shape)
                np.bitwise_count(np.bitwise_xor(rows, cols, out=xor), out=dist)
                np.less_equal(dist, limit[a : a + tall, None], out=self.hit[:size].reshape(shape))
                self.hit[size : size + 8] = False
                at = np.flatnonzero(self.hit[: (size + 7) // 8 * 8].view(np.uint64))  # eight cells at a time
                if len(at):
                    at = (at[:, None] * 8 + np.arange(8)).reshape(-1)
                    at = at[self.hit[at]]
                    i, j = np.divmod(at, shape[1])
                    yield i + a, j + c, self.dist[at]


class _Search:
    """The ``k`` nearest of a block's rows (bits ``x``, ascending ids ``own``) for its visitors (``q``, ``ids``).

    ``bound`` is the greatest distance that is of use to a visitor, or ``NONE``.  Either every row is compared
    (:meth:`dense`), or first those that agree best with the visitor in a band of its bits (:meth:`banded`).
    What is found is packed as ``visitor << 40 | distance << 32 | row`` and cut to ``k`` a visitor when it grows.
    """

    def __init__(self, x, own, q, ids, bound, k):
        self.x, self.own, self.q, self.ids, self.k = x, own, q, ids, k
        self.limit = np.minimum(bound, NONE).astype(np.uint8)
        self.sure = self.limit < NONE  # the limit is no less than the visitor's k-th best distance
        self.found, self.size, self.cut_at = [], 0, HELD
        self.compared = 0
        self.tiles = _Tiles()

    def add(self, parts, keep=None) -> None:
        """Parts ``(visitors, rows, distances)``; ``keep(xor)`` leaves out what was found before."""
        if not parts:
            return
        i, j, d = (np.concatenate(p) for p in zip(*parts))
        ok = self.own[j] != self.ids[i]
        if keep is not None:
            ok &= keep(self.q[i] ^ self.x[j])
        packed = i[ok].astype(np.int64) << 40 | d[ok].astype(np.int64) << 32 | j[ok].astype(np.int64)
        self.found.append(packed)
        self.size += len(packed)
        if self.size > self.cut_at:
            self.cut()
            self.cut_at = 2 * self.size + HELD

    def cut(self) -> np.ndarray:
        """The k least of every visitor, sorted; the k-th is its limit from now on."""
        packed = np.sort(np.concatenate([*self.found, np.empty(0, np.int64)]))
        who = packed >> 40
        rank = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        last = packed[rank == self.k - 1]
        at = last >> 40
        self.limit[at] = np.minimum(self.limit[at], (last >> 32) & 255)
        self.sure[at] = True
        packed = packed[rank < self.k]
        self.found, self.size = [packed], len(packed)
        return packed

    def dense(self, who: np.ndarray) -> None:
        first = self.x[:max(FIRST, self.k)]
        for a in range(0, len(who), max(1, CELLS // max(len(first), 1))):
            part = who[a : a + max(1, CELLS // max(len(first), 1))]
            if len(self.x) > self.k and not self.sure[part].all():
                # no more than the k-th best of the first rows can be among the k best of all
                d = np.bitwise_count(self.q[part, None] ^ first[None])
                d[self.ids[part, None] == self.own[None, : len(first)]] = NONE + 1
                most = np.partition(d, self.k - 1, axis=1)[:, self.k - 1]
                self.limit[part] = np.minimum(self.limit[part], most)
            held, size = [], 0
            for i, j, d in self.tiles.within(self.q[part], self.x, self.limit[part]):
                held.append((part[i], j, d))
                size += len(i)
                if size > CELLS:
                    self.add(held)
                    held, size = [], 0
            self.add(held)
        self.compared += len(who) * len(self.x)

    def banded(self) -> np.ndarray:
        """Searches by bands as long as that costs less than comparing all; the visitors that are left.

        A band's ring ``w`` are the rows whose value of the band differs from the visitor's in ``w`` bits.  Once the
        rings 0 to ``r`` of each band are done (-1: none), every row within the sum of ``r + 1``, less 1, was met.  The
        cheapest ring is next, by exact counts, so a band in which most rows agree is left to the last.
        """
        x, q, k = self.x, self.q, self.k
        bands = _layout(len(q))
        if not self.sure.all():
            self.limit[~self.sure] = self.usual()
        rv, qv = ([((v >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int32) for low, width in bands] for v in (x, q))
        order = [np.argsort(v, kind="stable").astype(np.int32) for v in rv]
        ends = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << width))]) for v, (_, width) in zip(rv, bands)]
        sums, done, spent = {}, [-1] * len(bands), 0
        active, rest = np.arange(len(q)), []
        while len(active):
            costs = []
            for b, (_, width) in enumerate(bands):
                ring = done[b] + 1
                if ring > width or math.comb(width, ring) << width > RING_WORK:
                    continue
                if (b, ring) not in sums:
                    n, every = np.diff(ends[b]), np.arange(1 << width)
                    sums[b, ring] = sum(n[every ^ mask] for mask in _masks(width, ring))
                here = np.bincount(qv[b][active], minlength=1 << width)
                costs.append((int(here @ sums[b, ring]) + TILE_COST * int(np.count_nonzero(here)), b))
            cost, b = min(costs, default=(0, None))
            if b is None or spent + cost > len(active) * len(x):
                break
            spent += cost
            self.ring(b, bands, qv[b], order[b], ends[b], done, active)
            done[b] += 1
            reach = sum(r + 1 for r in done) - 1
            held = np.concatenate([*self.found, np.empty(0, np.int64)])
            self.found = [held]
            near = np.bincount(held[(held >> 32 & 255) <= reach] >> 40, minlength=len(q))[active]
            over = (near >= k) | (self.sure[active] & (self.limit[active] <= reach))
            missed = ~over & ~self.sure[active] & (self.limit[active] <= reach)
            rest.append(active[missed])
            active = active[~over & ~missed]
        rest = np.concatenate([*rest, active])
        if len(rest):  # they begin again
            held, left = np.concatenate([*self.found, np.empty(0, np.int64)]), np.zeros(len(q), bool)
            left[rest] = True
            self.found = [held[~left[held >> 40]]]
            self.size = len(self.found[0])
            self.limit[rest[~self.sure[rest]]] = NONE
        return rest

    def ring(self, b: int, bands, values, order, ends, done, active) -> None:
        masks = _masks(bands[b][1], done[b] + 1)
        active = active[np.argsort(values[active], kind="stable")]
        values, q, sorted_x = values[active], self.q[active], self.x[order]
        before = [(np.uint64(low), np.uint64((1 << width) - 1), r) for (low, width), r in zip(bands, done) if r >= 0]

        def keep(xor):
            ok = np.ones(len(xor), bool)
            for low, mask, r in before:
                ok &= np.bitwise_count(xor >> low & mask) > r
            return ok

        starts = np.flatnonzero(np.diff(values, prepend=-1))
        held, size, count = [], 0, np.arange(len(self.x))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
            near = values[s] ^ masks
            first = ends[near]
            n = ends[near + 1] - first
            stop = np.cumsum(n)
            if not stop[-1]:
                continue
            at = np.repeat(first - stop + n, n) + count[: stop[-1]]
            self.compared += (e - s) * len(at)
            for i, j, d in self.tiles.within(q[s:e], sorted_x[at], self.limit[active[s:e]]):
                held.append((active[s + i], order[at[j]], d))
                size += len(i)
                if size > CELLS:
                    self.add(held, keep)
                    held, size = [], 0
        self.add(held, keep)

    def usual(self) -> int:
        """A distance within which nearly all visitors have their k-th best, from some of them."""
        some = np.linspace(0, len(self.q) - 1, min(64, len(self.q))).astype(np.int64)
        best = []
        for i in some:
            d = np.bitwise_count(self.x ^ self.q[i])
            d[self.own == self.ids[i]] = NONE
            best.append(np.partition(d, self.k - 1)[self.k - 1])
        self.compared += len(some) * len(self.x)
        return int(np.quantile(best, 0.95, method="higher"))


def _layout(visitors: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the bands that 64 bits are cut into: the fewer, the more visitors share a value."""
    bands = -(-64 // min(max(visitors.bit_length() - 4, 6), 13))
    cuts = [64 * b // bands for b in range(bands + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


@functools.lru_cache(256)
def _masks(width: int, ring: int) -> np.ndarray:
    return np.array([sum(1 << i for i in at) for at in itertools.combinations(range(width), ring)], np.int64)


def _first_alike(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The rows (ascending by id) without those of which enough alike come before: k, and as many as share an id."""
    order = np.argsort(x, kind="stable")
    rank = np.arange(len(x)) - np.searchsorted(x[order], x[order], side="left")
    same = np.diff(np.flatnonzero(np.diff(own, prepend=own[:1] - 1, append=own[-1:] + 1)))
    return np.sort(order[rank < k + same.max(initial=1)])


def _kernel(k: int):
    """Rows of one block (role 0) and its visitors (role 1) -> each visitor's k least (distance, id) in the block.

    A column ``bound``, if there is one, holds the greatest distance that is of use to a visitor (null: any).
    """
    def run(key, table):
        table = table.combine_chunks()
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        bits = table.column("bits").to_numpy().view(np.uint64)
        bound = table.column("bound").fill_null(NONE).to_numpy() if "bound" in table.column_names else np.full(len(ids), NONE)
        del table
        here, who = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        here = here[np.argsort(ids[here], kind="stable")]
        here = here[_first_alike(bits[here], ids[here], k)]
        x, own = bits[here], ids[here]
        out_id, out_key, compared = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for a in range(0, len(who) if len(here) else 0, VISITORS):
            part = who[a : a + VISITORS]
            search = _Search(x, own, bits[part], ids[part], bound[part], k)
            many = len(part) * len(x) >= BANDED_FROM and len(x) > 16 * k
            search.dense(search.banded() if many else np.arange(len(part)))
            best = search.cut()
            out_id.append(ids[part][best >> 40])
            out_key.append((best >> 32 & 255) << ID_BITS | own[best & 0xFFFFFFFF])
            compared += search.compared
        hash_id, keys = np.concatenate(out_id), np.concatenate(out_key)
        if compared and not len(hash_id):  # a row that only counts
            return pa.table({"hash_id": pa.array([None], pa.int64()), "k": pa.array([None], pa.int64()), "compared": [compared]})
        counts = np.zeros(len(hash_id), np.int64)
        counts[:1] = compared
        return pa.table({"hash_id": hash_id, "k": keys, "compared": counts})
    return run


def _grouped(rows: DataFrame, visits: DataFrame, k: int, chunks: int) -> DataFrame:
    """Blocks ``(m, block)`` of rows with their visitors, the latter dealt to ``chunks`` groups a block."""
    left = rows.select("id", "bits", F.lit(0).alias("role"), F.lit(None).cast("int").alias("bound"), "m", "block",
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = visits.select("id", "bits", F.lit(1).alias("role"), "bound", "m", "block",
                          F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))
    sides = left.unionByName(right).repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism, "m", "block", "chunk")
    return sides.groupBy("m", "block", "chunk").applyInArrow(_kernel(k), "hash_id long, k long, compared long")


def place(cells: dict, pivots: np.ndarray, block: int) -> dict:
    """``{cell: (first block, blocks)}`` of a method from ``{cell: rows}``.

    A cell of more than ``block`` rows has blocks of its own; others share one, each with the cells whose pivots are next to it.
    """
    out, number, filled = {}, 0, 0
    for c in sorted(cells):
        if cells[c] > block:
            out[c] = (number, -(-cells[c] // block))
            number += out[c][1]
    here = set(cells) - set(out)
    total = sum(cells[c] for c in here)
    share = -(-total // max(1, -(-total // block)))
    at = min(here, default=None)
    while here:
        here.remove(at)
        if filled and (filled >= share or filled + cells[at] > block):
            number, filled = number + 1, 0
        out[at] = (number, 1)
        filled += cells[at]
        at = min(here, key=lambda c: (int(np.bitwise_count(pivots[c] ^ pivots[at])), c), default=None)
    return out


def _visits(chosen: dict, ranges: dict, placed: dict):
    """Hashes (id, m, bits, home, bound) -> a row for each block other than ``home`` with a cell that isn't ruled out."""
    plans = {}
    for m, cells in placed.items():
        names = sorted(cells)
        low, high = (np.array([[r[side] for r in ranges[m][c]] for c in names], np.int16) for side in (0, 1))
        holds = np.zeros((len(names), max(f + n for f, n in cells.values())), bool)
        for row, c in enumerate(names):
            holds[row, cells[c][0] : sum(cells[c])] = True
        plans[m] = np.array(chosen[m], np.int64).view(np.uint64), low, high, holds

    def run(batches):
        for batch in batches:
            methods = batch.column("m").to_pylist()
            names = np.array(methods, object)
            bits = batch.column("bits").to_numpy().view(np.uint64)
            home, bound = batch.column("home").to_numpy(), batch.column("bound").fill_null(NONE).to_numpy()
            for m in dict.fromkeys(methods):
                pivots, low, high, holds = plans[m]
                at = np.flatnonzero(names == m)
                far = np.bitwise_count(bits[at, None] ^ pivots[None]).astype(np.int16)
                goes = np.zeros((len(at), holds.shape[1]), bool)
                for c in range(len(low)):
                    gap = np.maximum(low[c] - far, far - high[c]).max(axis=1)
                    goes[:, holds[c]] |= (gap <= bound[at])[:, None]
                goes[np.arange(len(at)), home[at]] = False
                i, block = np.nonzero(goes)
                part = batch.select(["id", "bits", "m", "bound"]).take(pa.array(at[i]))
                yield part.append_column("block", pa.array(block, pa.int32()))
    return run


def _least(pairs: DataFrame, k: int) -> DataFrame:
    """(hash_id, best): the k least keys of every hash, of at most k a group that it visited."""
    return pairs.where("hash_id is not null").groupBy("hash_id").agg(F.slice(F.sort_array(F.collect_list("k")), 1, k).alias("best"))


def search(fp: DataFrame, k: int, id_col: str = "id", method_col: str = "hashing_method_id", pivots: int = PIVOTS,
           block: int | None = None) -> Found:
    spark = fp.sparkSession
    stats = assert_equal_lengths(fp, method_col, "hash", id_col).collect()
    none = spark.createDataFrame([], "hash_id long, rank int, neighbour_id long, distance_bits int")
    if not stats:
        return Found(none, 0, 0)
    if max(r["nbits"] for r in stats) > 64 or min(r["min_id"] for r in stats) < 0 or max(
            r["max_id"] for r in stats) >= 1 << ID_BITS:
        raise ValueError(f"the k-nearest search needs hashes of at most 64 bits and ids in [0, 2^{ID_BITS})")
    total = sum(r["n"] for r in stats)
    slots = spark.sparkContext.defaultParallelism
    block = block or BLOCK
    rows = materialise(fp.select(F.col(id_col).cast("bigint").alias("id"), F.col(method_col).alias("m"),
                                 hex_to_bits("hash").alias("bits")), "nearest-rows")
    # pivots: a bounded sample of each method, by digest
    chosen = {}
    for r in stats:
        some = rows.where(F.col("m") == r[method_col]).select("bits").orderBy(F.xxhash64("id", "bits")).limit(SAMPLE)
        bits = np.array([x["bits"] for x in some.collect()], np.int64).view(np.uint64)
        chosen[r[method_col]] = far_apart(bits, min(pivots, max(1, r["n"] // min(block, CELL) * 4))).view(np.int64).tolist()
    at = F.create_map(*[x for m, p in chosen.items() for x in (F.lit(m), F.lit(p).cast("array<bigint>"))])
    apart = F.transform(F.element_at(at, F.col("m")), lambda p: F.bit_count(F.col("bits").bitwiseXOR(p)).cast("int"))
    dealt = materialise(rows.withColumn("far", apart).withColumn("cell", (F.array_position(
        "far", F.array_min("far")) - 1).cast("int")).withColumn("row", F.monotonically_increasing_id()), "nearest-cells")
    # rows, and the least and the greatest distance to each pivot, of at most ``pivots`` cells a method
    most = max(map(len, chosen.values()))
    far = [F.get("far", F.lit(p)) for p in range(most)]
    sizes = dealt.where("cell is not null").groupBy("m", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*map(F.min, far)).alias("low"), F.array(*map(F.max, far)).alias("high")).collect()
    ranges, cells = {}, {}
    for r in sizes:
        ranges.setdefault(r["m"], {})[r["cell"]] = list(zip(r["low"], r["high"]))[:len(chosen[r["m"]])]
        cells.setdefault(r["m"], {})[r["cell"]] = r["n"]
    placed = {m: place(c, np.array(chosen[m], np.int64).view(np.uint64), block) for m, c in cells.items()}
    size = spark.createDataFrame([(m, c, *x) for m, p in placed.items() for c, x in p.items()], T.StructType(
        [dealt.schema["m"], dealt.schema["cell"]]).add("first", T.IntegerType()).add("blocks", T.IntegerType()))
    dealt = dealt.join(F.broadcast(size), ["m", "cell"]).select("id", "m", "bits", (
        F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int").alias("block"))
    # groups for every slot some; a visitor is in one of a block's
    least = -(-4 * slots // max(1, sum(max(sum(x) for x in p.values()) for p in placed.values())))
    # the bound of each hash: the k-th best in a block of its own cell
    nothing = F.lit(None).cast("int").alias("bound")
    own = materialise(_grouped(dealt, dealt.select("*", nothing), k, max(least, -(-min(block, total) // VISITORS))), "nearest-own")
    first = _least(own, k).withColumn("bound", F.when(F.size("best") >= k, F.shiftright(
        F.element_at("best", k), ID_BITS).cast("int")))
    # blocks with cells that may hold a nearer hash; the own block is done
    mine = dealt.withColumnRenamed("block", "home").join(first.select(F.col("hash_id").alias("id"), "bound"), "id", "left")
    kind = dealt.schema["m"].dataType.simpleString()
    visits = mine.mapInArrow(_visits(chosen, ranges, placed), f"id long, bits long, m {kind}, bound int, block int")
    found = materialise(_grouped(dealt, visits, k, max(least, -(-max(r["n"] for r in stats) // VISITORS))).unionByName(own),
                        "nearest-found")
    best = _least(found, k).select("hash_id", F.posexplode("best").alias("rank", "k"))
    compared = found.agg(F.sum("compared").alias("c")).first()["c"] or 0
    neighbours = best.select("hash_id", (F.col("rank") + 1).alias("rank"),
                             F.col("k").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("neighbour_id"),
                             F.shiftright("k", ID_BITS).cast("int").alias("distance_bits"))
    return Found(neighbours, sum(r["n"] * r["n"] for r in stats), int(compared))
