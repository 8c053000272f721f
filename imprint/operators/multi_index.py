"""Near-duplicate hashes by multi-index hashing: bands, probes around their values, verification.

Hashes of one method within ``t`` bits of each other are found without the all-pairs product and without
loss.  The bits are cut into ``m`` bands with radii r_1..r_m, sum of (r_i + 1) = t + 1: two hashes that differ
in at most t bits differ in at most r_i bits on some band i, or they would differ in t + 1.  Every hash is
stored under its value of each band, and probes all values within the band's radius of its own.  With four
bands of 16 bits and t = 14 (radii 3, 3, 3, 2) a hash meets 3.4% of random others, where equal bands alone need
t + 1 = 15 bands of 4 to 5 bits and meet 57%.

* Hashes are dealt to block pairs, as for the all-pairs match; probes are made and met inside a block pair, through
  an index of its values, so none is shuffled and a hash travels once for every block.
* A pair is verified on all bits, and kept from the first band within its radius only, so no distinct is needed.
* Blocks go by a hash of the id: no task gets the whole of a value, however many of the hashes share it.
* :func:`candidates` drops probes of values that no hash has by a bitmap of the values present (at most 2^width bits
  a band and method, a bound that doesn't grow with the rows, so it is broadcast) before anything is shuffled.

``bands`` is named by the caller (about bits / log2(rows) is best); hashes have one width of up to 64 bits.
Repeated rows give a pair for each; rows of one id are never paired; hashes under null methods are not
compared.  An invalid or null hash raises.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.functions.bits import assert_equal_lengths, hex_to_bits
from imprint.operators import block_pairs as BP
from imprint.operators import match as M
from imprint.operators.analytics import block_groups
from imprint.session import materialise

BANDS = 4
MOST_BAND_BITS = 20  # of the bitmap of values present: 2^20 bits a band and method


def radii(t: int, bands: int) -> list[int]:
    """Radius of each band, the sum of (radius + 1) being t + 1; -1: the band isn't needed."""
    base, extra = divmod(t + 1, bands)
    return [base - 1 + (i < extra) for i in range(bands)]


def layout(t: int, nbits: int, bands: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each band that is needed; widths differ by at most one."""
    base, extra = divmod(nbits, bands)
    out, top = [], nbits
    for i, r in enumerate(radii(t, bands)):
        width = base + (i < extra)
        top -= width
        if r >= 0 and width:
            out.append((top, width, min(r, width)))
    return out


def probes(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _value(bits: Column, low: int, width: int) -> Column:
    mask = -1 if width >= 64 else (1 << width) - 1
    return F.shiftrightunsigned(bits, low).bitwiseAND(F.lit(mask).cast("bigint"))


def _rows(fp: DataFrame, id_col: str, method_col: str) -> DataFrame:
    return fp.where(F.col(method_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(method_col).alias("m"), hex_to_bits("hash").alias("bits"))


def _stored(rows: DataFrame, bands: list) -> DataFrame:
    return rows.select("id", "m", "bits", F.inline(F.array(*[
        F.struct(F.lit(i).alias("band"), _value(F.col("bits"), low, width).alias("value"))
        for i, (low, width, _) in enumerate(bands)])))


def _probing(rows: DataFrame, stored: DataFrame, bands: list) -> DataFrame:
    """(id, m, bits, band, value) for every value present within the band's radius of the hash's own."""
    value = F.col("value")
    masks = [F.lit(i) == F.col("band") for i in range(len(bands))]
    near = F.when(masks[0], F.lit(probes(*bands[0][1:])).cast("array<bigint>"))
    for is_band, (_, width, radius) in zip(masks[1:], bands[1:]):
        near = near.when(is_band, F.lit(probes(width, radius)).cast("array<bigint>"))
    around = _stored(rows, bands).withColumn("mask", F.explode(near)).select(
        "id", "m", "bits", "band", value.bitwiseXOR(F.col("mask")).alias("value"))
    if max(width for _, width, _ in bands) > MOST_BAND_BITS:
        return around
    words = stored.groupBy("m", "band", F.shiftright("value", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(value & 63 as int))")).alias("present"))
    bit = F.expr("shiftrightunsigned(present, cast(value & 63 as int)) & 1")
    # proven bound: 2^(width - 6) rows a band and method
    return around.withColumn("word", F.shiftright("value", 6)).join(F.broadcast(words), ["m", "band", "word"]).where(
        bit == 1).drop("word", "present")


def _plan(fp: DataFrame, threshold_bits: int, bands: int, id_col: str, method_col: str):
    widths = {r["nbits"] for r in assert_equal_lengths(fp, method_col, "hash", id_col).collect()}
    if len(widths) > 1 or (widths and max(widths) > 64):
        raise ValueError(f"multi-index search needs one hash width of at most 64 bits, got {sorted(widths)}")
    nbits = widths.pop() if widths else 64
    return layout(threshold_bits, nbits, bands), nbits


def candidates(fp: DataFrame, threshold_bits: int, bands: int = BANDS, id_col: str = "id",
               method_col: str = "hashing_method_id") -> int:
    """Exact number of (pair, band) meetings of :func:`near_pairs`, from counts a value; no pair is made."""
    plan, _ = _plan(fp, threshold_bits, bands, id_col, method_col)
    rows = materialise(_rows(fp, id_col, method_col), "multi-index-rows")
    stored = _stored(rows, plan)
    there = stored.groupBy("m", "band", "value").agg(F.count(F.lit(1)).alias("s"))
    # radius 0 rows meet themselves; every other meeting is counted from both sides
    around = _probing(rows, stored, plan).groupBy("m", "band", "value").agg(F.count(F.lit(1)).alias("p"))
    met = around.join(there, ["m", "band", "value"]).agg(F.sum(F.col("s") * F.col("p")).alias("c")).first()["c"] or 0
    return (int(met) - rows.count() * len(plan)) // 2


def near_pairs(fp: DataFrame, threshold_bits: int, bands: int = BANDS, id_col: str = "id",
               method_col: str = "hashing_method_id", hot: int | None = None) -> DataFrame:
    """``(hash_id1, hash_id2, hamming_distance, method)``, hash_id1 < hash_id2, of all pairs within ``threshold_bits``.

    Blocks have up to ``hot`` rows (by default as many as fit a task's memory), however many share a value.
    """
    layout_, _ = _plan(fp, threshold_bits, bands, id_col, method_col)
    fp = fp.where(F.col(method_col).isNotNull())
    plan = M.plan_match(fp, method_col, "hash", id_col=id_col, target_pairs_per_task=hot * hot if hot else None)
    kernel = BP.near_probed(threshold_bits, layout_, [probes(width, radius) for _, width, radius in layout_])
    found = block_groups(fp, plan, id_col, method_col).applyInArrow(
        kernel, BP.NEAR_SCHEMA.format(fp.schema[method_col].dataType.simpleString()))
    return M.normalised(found, plan, method_col)
