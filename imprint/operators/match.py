"""All-pairs matching of fingerprints within a hashing method (triangular self-join).

Semantics: for every method, every pair of its hashes with ``id1 <= id2`` —
self-pairs included — gets the normalised Hamming distance; n hashes give
n(n+1)/2 rows.  There is no distance cut-off.

The only equi key is the method (a handful of values), so a plain join would
put a whole method in one task.  Two physical shapes, named by the caller; the
rows never choose:

* ``broadcast`` — for tables that the caller knows to be small: the probe side is
  spread round-robin over many tasks and the build side is broadcast.  No shuffle
  of pairs, no skew: every task sees the same share of probe rows.  Pairs come out by
  tiles of ids, which take less room when they are written.  More than
  ``broadcast_max_bytes`` of join rows raise.
* ``blocks`` (the default) — each method's hashes are hashed into B blocks and
  each block pair (i <= j) becomes its own join key ``(method, i, j)``: a row of
  block b is sent as left to (b, j >= b) and as right to (i <= b, b), so it is
  replicated B + 1 times and every block pair holds about (n/B)^2 pairs.  B is
  chosen per method, so a method holding a third of all rows simply gets more
  blocks.  Both sides are repartitioned explicitly on the block-pair key with a
  count bounded by the slots, not by n^2 (AQE does not coalesce that), so a task
  takes several block pairs, and the join reuses the partitioning.  Where pairs
  come out, blocks have about ``WRITTEN_BLOCK`` rows, in the order of their ids, so
  that the ids of the pairs take less room when they are written.

Both shapes return identical rows; pairs in different blocks are ordered as
``least/greatest(id)`` and pairs inside a block by ``id1 <= id2``.  Consumers
that only need counts (histograms, sweeps, nearest) aggregate on top of the
returned DataFrame, so the partial aggregate runs in the join stage and pairs
are never written out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.functions.bits import assert_equal_lengths, hex_to_bits, hex_to_words, words_bit_count

BROADCAST_MAX_BYTES = 64 << 20
TARGET_PAIRS_PER_TASK = 20_000_000  # broadcast shape
BLOCK_PAIRS = 10_000_000_000  # pairs of a block pair: blocks of about 100,000 rows, which fit a task's memory
TILE_ROWS = 256  # broadcast shape: rows of a method with neighbouring ids that a run of pairs goes through
WRITTEN_BLOCK = 4096  # blocks shape: rows of a block where the pairs themselves come out
PARTITIONS_PER_SLOT = 32  # most partitions that the block pairs are dealt to, whatever their number


@dataclass(frozen=True)
class MatchPlan:
    shape: str
    counts: dict  # method -> (rows, nbits)
    blocks: dict  # method -> B (blocks shape only)
    partitions: int
    id_range: tuple = (0, 0)  # (min id, max id) over all methods
    max_ids: dict = None  # method -> largest id
    cuts: dict = None  # method -> ids between its tiles (broadcast shape only)

    @property
    def all64(self) -> bool:
        """Every method is exactly 64 bits wide (what the pigeonhole bands assume)."""
        return all(nb == 64 for _, nb in self.counts.values())

    @property
    def wide(self) -> bool:
        """Any method wider than 64 bits: hashes travel as word arrays instead of one BIGINT."""
        return any(nb > 64 for _, nb in self.counts.values())


def prepare(hashes: DataFrame, id_col: str = "id", method_col: str = "hashing_method_id",
            hash_col: str = "hash", carry: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """Narrow join rows: (id, method, bits, *carry).  Raster and text columns never enter.

    ``bits`` is one BIGINT for hashes up to 64 bits, else an ARRAY<BIGINT> of 16-digit chunks.
    """
    return hashes.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(method_col).alias("m"),
        (hex_to_words(hash_col) if wide else hex_to_bits(hash_col)).alias("bits"),
        *carry,
    )


def bit_diff(b1, b2, wide: bool = False):
    """Number of differing bits of two prepared ``bits`` values."""
    c1 = F.col(b1) if isinstance(b1, str) else b1
    c2 = F.col(b2) if isinstance(b2, str) else b2
    return words_bit_count(c1, c2) if wide else F.bit_count(c1.bitwiseXOR(c2))


def plan_match(hashes: DataFrame, method_col: str = "hashing_method_id", hash_col: str = "hash",
               shape: str = "blocks", broadcast_max_bytes: int = BROADCAST_MAX_BYTES,
               target_pairs_per_task: int | None = None, id_col: str = "id", carry: tuple[str, ...] = ()) -> MatchPlan:
    """Partitions and blocks of a shape from per-method row counts (one row per method reaches the driver)."""
    if shape not in ("blocks", "broadcast"):
        raise ValueError(f"shape is 'blocks' or 'broadcast', not {shape!r}")
    stats = assert_equal_lengths(hashes, method_col, hash_col, id_col).collect()
    counts = {r[method_col]: (int(r["n"]), int(r["nbits"])) for r in stats}
    id_range = (min((int(r["min_id"]) for r in stats), default=0), max((int(r["max_id"]) for r in stats), default=0))
    max_ids = {r[method_col]: int(r["max_id"]) for r in stats}
    total = sum(n for n, _ in counts.values())
    slots = max(hashes.sparkSession.sparkContext.defaultParallelism, 1)
    pairs = sum(n * (n + 1) // 2 for n, _ in counts.values())
    if shape == "broadcast":
        wide = max((nb for _, nb in counts.values()), default=64)
        size = total * (24 + max(8, wide // 8) + sum(_width(hashes.schema[c].dataType) for c in carry))
        if size > broadcast_max_bytes:
            raise ValueError(f"about {size} bytes of {total} hashes are too many to broadcast; use shape='blocks'")
        parts = max(slots * 2, math.ceil(pairs / (target_pairs_per_task or TARGET_PAIRS_PER_TASK)))
        return MatchPlan("broadcast", counts, {}, parts, id_range, max_ids, tile_cuts(hashes, counts, method_col, id_col))
    blocks, parts = plan_blocks(counts, slots, target_pairs_per_task or BLOCK_PAIRS)
    return MatchPlan("blocks", counts, blocks, parts, id_range, max_ids)


def tile_cuts(hashes: DataFrame, counts: dict, method_col: str, id_col: str) -> dict:
    """Ids that cut each method into tiles of about ``TILE_ROWS`` rows (at most one row a method reaches the driver)."""
    tiles = {m: -(-n // TILE_ROWS) for m, (n, _) in counts.items() if m is not None}
    most = max(tiles.values(), default=1)
    if most < 2:
        return {}
    at = F.percentile_approx(F.col(id_col).cast("bigint"), [i / most for i in range(1, most)], max(10_000, 100 * most))
    found = {r["m"]: r["at"] for r in hashes.groupBy(F.col(method_col).alias("m")).agg(at.alias("at")).collect()}
    return {m: sorted({(found[m] or [])[i * most // n - 1] for i in range(1, n) if found[m]}) for m, n in tiles.items()}


def _width(kind) -> int:
    """Bytes of a carried value in a join row, by its type's default size (strings and arrays: their estimate)."""
    return {"integer": 8, "long": 8, "boolean": 8, "double": 8}.get(kind.typeName(), 64)


def plan_blocks(counts: dict, slots: int, target_pairs: int = BLOCK_PAIRS) -> tuple[dict, int]:
    """Blocks per method and the partition count: one per block pair, up to ``PARTITIONS_PER_SLOT`` a slot."""
    blocks = {}
    for m, (n, _) in counts.items():
        # an off-diagonal block pair holds (n/B)^2 pairs, a diagonal one half that: ~ target
        b = max(1, math.ceil(n / math.sqrt(float(target_pairs))))
        # enough block pairs to keep every slot busy with dynamic scheduling
        while b * (b + 1) // 2 < slots * 4 and b < max(n, 1):
            b += 1
        blocks[m] = b
    pairs = sum(b * (b + 1) // 2 for b in blocks.values())
    return blocks, max(1, min(pairs, slots * PARTITIONS_PER_SLOT))


def _nbits_expr(widths: dict):
    """Bit width per method as a literal (one width) or a small literal map."""
    if all(nb == 64 for nb in widths.values()):
        return F.lit(64.0)
    pairs = [x for m, nb in widths.items() for x in (F.lit(m), F.lit(float(nb)))]
    return F.element_at(F.create_map(*pairs), F.col("m"))


def normalised(found: DataFrame, plan: MatchPlan, method_col: str) -> DataFrame:
    """Pairs ``(hash_id1, hash_id2, distance_bits, m)`` with the distance as a share of the method's bits."""
    nbits = _nbits_expr({m: nb for m, (_, nb) in plan.counts.items()})
    return found.select("hash_id1", "hash_id2", (F.col("distance_bits").cast("double") / nbits.cast("double")).alias(
        "hamming_distance"), F.col("m").alias(method_col))


def _with_distance(pairs: DataFrame, nbits_expr, wide: bool = False) -> DataFrame:
    d = bit_diff("bits1", "bits2", wide)
    return pairs.withColumn("distance_bits", d.cast("int")) \
        .withColumn("hamming_distance", F.col("distance_bits").cast("double") / nbits_expr.cast("double"))


def block_sides(rows: DataFrame, plan: MatchPlan) -> tuple[DataFrame, DataFrame]:
    """:func:`prepare`'d rows as left and right sides of the block pairs ``(m, bi, bj)``, dealt to the plan's partitions."""
    bmap = F.create_map(*[x for m, b in plan.blocks.items() for x in (F.lit(m), F.lit(b))])
    keyed = rows.withColumn("_b", F.element_at(bmap, F.col("m"))) \
        .withColumn("_blk", F.pmod(F.xxhash64("id"), F.col("_b")).cast("int"))
    left = keyed.select(
        *rows.columns, F.col("_blk").alias("bi"), F.explode(F.sequence(F.col("_blk"), F.col("_b") - 1)).alias("bj"))
    right = keyed.select(
        *rows.columns, F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("bi"), F.col("_blk").alias("bj"))
    return (left.repartition(plan.partitions, "m", "bi", "bj"), right.repartition(plan.partitions, "m", "bi", "bj"))


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """Sorted within partitions: the planner takes a sort below a join away, but not from below row numbers that are used."""
    rows = rows.sortWithinPartitions(*columns)
    return rows.withColumn("_row", F.monotonically_increasing_id()).where("_row >= 0").drop("_row")


def match_pairs(hashes: DataFrame, plan: MatchPlan | None = None, id_col: str = "id",
                method_col: str = "hashing_method_id", hash_col: str = "hash",
                carry: tuple[str, ...] = (), keep_bits: bool = False, with_bits: bool = False,
                **plan_kw) -> DataFrame:
    """(hash_id1, hash_id2, hamming_distance, hashing_method_id[, carry1/2...]) for all pairs.

    ``carry`` columns of the input (e.g. image ids) come out suffixed ``1``/``2``;
    ``with_bits`` adds ``distance_bits`` (the integer count of differing bits).
    """
    if plan is None:
        plan_kw = {"shape": "blocks"} | plan_kw
        if plan_kw["shape"] == "blocks" and plan_kw.get("target_pairs_per_task") is None:
            plan_kw["target_pairs_per_task"] = WRITTEN_BLOCK ** 2
        plan = plan_match(hashes, method_col, hash_col, id_col=id_col, carry=carry, **plan_kw)
    rows = prepare(hashes, id_col, method_col, hash_col, carry, wide=plan.wide)
    nbits = _nbits_expr({m: nb for m, (_, nb) in plan.counts.items()})

    def side(df, suffix):
        return df.select(
            F.col("id").alias(f"id{suffix}"), F.col("bits").alias(f"bits{suffix}"),
            *[F.col(c).alias(f"{c}{suffix}") for c in carry],
            *[c for c in df.columns if c in ("m", "bi", "bj", "tile")],
        )

    if plan.shape == "broadcast":
        left, right, on = rows.repartition(plan.partitions), rows, ["m"]
        if plan.cuts:
            # tile after tile: a run of pairs has one id on the left and goes through the same few ids on the right, so
            # a writer's dictionaries and its compression take next to nothing for either; earlier tiles have no pair
            cuts = F.element_at(F.create_map(*[x for m, c in plan.cuts.items() for x in (
                F.lit(m), F.lit(c) if c else F.array().cast("array<bigint>"))]), F.col("m"))
            tile = F.when(F.col("id").isNotNull(), F.size(F.filter(cuts, lambda c: c < F.col("id"))))
            left = _in_order(left.select("*", F.explode(F.sequence(tile, F.size(cuts))).alias("tile")), "m", "tile", "id")
            right, on = rows.select("*", tile.alias("tile")), ["m", "tile"]
        joined = side(left, "1").join(F.broadcast(side(right, "2")), on=on, how="inner").where(F.col("id1") <= F.col("id2"))
        out = joined
    else:
        # by id inside a block pair: ids come out in runs and in the same sequence for every left row
        left, right = (_in_order(x, "m", "bi", "bj", "id") for x in block_sides(rows, plan))
        left, right = side(left, "1"), side(right, "2")
        joined = left.join(right, on=["m", "bi", "bj"], how="inner").where(
            (F.col("bi") < F.col("bj")) | (F.col("id1") <= F.col("id2"))
        )
        swap = F.col("id1") > F.col("id2")
        out = joined.select(
            "m",
            *[F.when(swap, F.col(f"{n}2")).otherwise(F.col(f"{n}1")).alias(f"{n}1") for n in ("id", "bits", *carry)],
            *[F.when(swap, F.col(f"{n}1")).otherwise(F.col(f"{n}2")).alias(f"{n}2") for n in ("id", "bits", *carry)],
        )
    out = _with_distance(out, nbits, plan.wide)
    cols = [
        F.col("id1").alias("hash_id1"), F.col("id2").alias("hash_id2"), "hamming_distance",
        F.col("m").alias(method_col),
        *[F.col(f"{c}{s}") for c in carry for s in ("1", "2")],
    ]
    if keep_bits:
        cols += ["bits1", "bits2"]
    if with_bits:
        cols += ["distance_bits"]
    return out.select(*cols)


def match_rectangle(a: DataFrame, b: DataFrame, id_col: str = "id", method_col: str = "hashing_method_id",
                    hash_col: str = "hash", target_pairs_per_task: int | None = None) -> DataFrame:
    """All pairs between two disjoint hash sets of the same method (new x old of an incremental run).

    Pairs come out as (least(id), greatest(id)).
    """
    l, r, wide, widths = rectangle_sides(a, b, id_col, method_col, hash_col, target_pairs_per_task)
    l = l.select(F.col("id").alias("id1"), F.col("bits").alias("bits1"), "m", "bi", "bj")
    r = r.select(F.col("id").alias("id2"), F.col("bits").alias("bits2"), "m", "bi", "bj")
    j = l.join(r, ["m", "bi", "bj"])
    return j.select(
        F.least("id1", "id2").alias("hash_id1"), F.greatest("id1", "id2").alias("hash_id2"),
        (bit_diff("bits1", "bits2", wide).cast("double") / _nbits_expr(widths)).alias("hamming_distance"),
        F.col("m").alias(method_col),
    )


def rectangle_sides(a: DataFrame, b: DataFrame, id_col: str = "id", method_col: str = "hashing_method_id",
                    hash_col: str = "hash", target_pairs_per_task: int | None = None) -> tuple:
    """``(left, right, wide, widths)``: both sets cut into blocks (Ba x Bb grid per method, each row replicated to one
    grid row or column) and dealt to partitions by ``(m, bi, bj)``."""
    st_a = assert_equal_lengths(a, method_col, hash_col).collect()
    st_b = assert_equal_lengths(b, method_col, hash_col).collect()
    sa = {r[method_col]: int(r["n"]) for r in st_a}
    sb = {r[method_col]: int(r["n"]) for r in st_b}
    widths = {r[method_col]: int(r["nbits"]) for r in st_a}
    for r in st_b:
        if widths.setdefault(r[method_col], int(r["nbits"])) != int(r["nbits"]):
            raise ValueError("Hashes must have the same length")
    wide = any(nb > 64 for nb in widths.values())
    ra, rb = prepare(a, id_col, method_col, hash_col, wide=wide), prepare(b, id_col, method_col, hash_col, wide=wide)
    slots = max(a.sparkSession.sparkContext.defaultParallelism, 1)
    side = math.sqrt(float(target_pairs_per_task or BLOCK_PAIRS))
    grid = {}
    for m in sa:
        ba, bb = max(1, math.ceil(sa[m] / side)), max(1, math.ceil(sb.get(m, 0) / side))
        while ba * bb < slots * 4 and (ba < sa[m] or bb < sb.get(m, 0)):  # enough of the grid for every slot
            if bb >= sb.get(m, 0) or (ba < sa[m] and sa[m] * bb >= sb.get(m, 0) * ba):
                ba += 1
            else:
                bb += 1
        grid[m] = (ba, bb)
    if not grid:
        grid = {-1: (1, 1)}
    ga = F.create_map(*[x for m, (ba, _) in grid.items() for x in (F.lit(m), F.lit(ba))])
    gb = F.create_map(*[x for m, (_, bb) in grid.items() for x in (F.lit(m), F.lit(bb))])
    parts = max(1, min(sum(ba * bb for ba, bb in grid.values()), slots * PARTITIONS_PER_SLOT))
    l = ra.select("*", F.pmod(F.xxhash64("id"), F.element_at(ga, F.col("m"))).cast("int").alias("bi"),
                  F.explode(F.sequence(F.lit(0), F.element_at(gb, F.col("m")) - 1)).alias("bj"))
    r = rb.select("*", F.explode(F.sequence(F.lit(0), F.element_at(ga, F.col("m")) - 1)).alias("bi"),
                  F.pmod(F.xxhash64("id"), F.element_at(gb, F.col("m"))).cast("int").alias("bj"))
    return l.repartition(parts, "m", "bi", "bj"), r.repartition(parts, "m", "bi", "bj"), wide, widths


def match_progress(matches: DataFrame):
    """Attach a row counter to a match output (A3/T4): returns (df, observation).

    ``observation.get["matched"]`` is filled once an action has run on ``df``.
    """
    from pyspark.sql import Observation

    obs = Observation("match_progress")
    return matches.observe(obs, F.count(F.lit(1)).alias("matched")), obs
