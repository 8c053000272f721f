"""MinHash near-duplicates with b-bit signatures (operator 10).

A document's set is its distinct 5-word shingles over words ``[^\\x20\\x09-\\x0D]+``
with A-Z lower-cased; fewer words give one shingle, no words give an empty set.
Documents with Jaccard similarity >= 0.75 are linked; components are reported.

Method
  1. One scan: 256 minima per document; their low 4 bits are packed as four
     256-bit planes (16 longs); 32 bands of 4 full minima give bucket keys.
  2. Equal sets collapse to their smallest id, so copies cost one row.
  3. Each member is paired with the smallest id that it shares a bucket with; the
     similarity is estimated from the packed planes by bit counts, corrected for
     chance agreement, and hopeless pairs go; the rest is confirmed on full sets.
  4. After components of the confirmed links, buckets that still hold members
     of different components are compared in bounded blocks.  First, in rounds
     over a quarter of the bands each, a block of n members gives at most n - 1
     pairs: the forest of its components that follows the highest estimates
     (blocks are drawn anew per band, so rounds join them).  Then, over what is
     still apart, every likely pair, in the first band that it shares, unless the
     shingles that no other such member holds rule it out: two sets of sizes a
     and b that share at most m with all others have a similarity of at most
     m / (a + b - m).  Only pairs across components leave a block, so no link
     between components is lost and near copies never emit all their pairs.

At similarity 0.75 a pair shares no band with probability (1 - 0.75^4)^32 < 6e-6.

Defined cases: null or wordless text: empty set, linked with nothing, own
component.  Null doc_id: own row, component_id null, kept true (it cannot be
compared by id).  Repeated rows are returned each.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import HashOf, components, freeing, mix64, save

WORDS = 5
NUM, DEN = 75, 100  # linked from this similarity on
PERMS, BANDS, ROWS, LOW_BITS = 256, 32, 4, 4
LONGS = PERMS // 64
KEEP_FROM = 0.63  # estimated similarity from which a pair is confirmed on full sets (4.2 sigma below 0.75)
ROUNDS = 2  # forest rounds before every likely pair across components is confirmed
BLOCK = 2048

_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
               0xA0761D6478BD642F], dtype=np.uint64)
_R = np.random.default_rng(20240607)
_MUL = (_R.integers(0, 2**32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _R.integers(0, 2**32, PERMS, dtype=np.uint64).astype(np.uint32)
_BAND = _R.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_HASH = HashOf()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    if n < WORDS:
        s = np.full(1, n, np.uint64)
        for j in range(n):
            s = s + h[j:j + 1] * _M[j]
        return mix64(s)
    s = h[: n - WORDS + 1] * _M[0]
    for j in range(1, WORDS):
        s = s + h[j : n - WORDS + 1 + j] * _M[j]
    return np.unique(mix64(s))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, ((x[i : i + 1024, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def planes(mins: np.ndarray) -> np.ndarray:
    """(n, PERMS) minima -> longs: bit plane p of the low bits in words p * LONGS up to (p + 1) * LONGS."""
    parts = [np.packbits((mins >> np.uint32(p) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
             for p in range(LOW_BITS)]
    return np.concatenate(parts, axis=1).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins[:, : BANDS * ROWS].astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    return mix64((mix64(m + np.uint64(1)) * _BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()),
                  ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _signatures(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        n, hi, lo = [], [], []
        mins = np.zeros((len(texts), PERMS), np.uint32)
        for i, t in enumerate(texts):
            s = shingle_set(t)
            n.append(len(s))
            d = xxhash.xxh3_128_digest(s.tobytes())
            hi.append(int.from_bytes(d[:8], "big", signed=True))
            lo.append(int.from_bytes(d[8:], "big", signed=True))
            if len(s):
                mins[i] = minima(s)
        off = np.arange(len(texts) + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
            pa.ListArray.from_arrays(pa.array(off * LONGS * LOW_BITS), pa.array(planes(mins).ravel())),
            pa.ListArray.from_arrays(pa.array(off * BANDS), pa.array(band_keys(mins).ravel()))], schema=_SIG)


def estimate(a: str, b: str):
    """Collision-corrected similarity of two packed signatures, as a Column of bit counts."""
    differ = sum((F.bit_count(F.expr(" | ".join(f"({a}[{LONGS * p + w}] ^ {b}[{LONGS * p + w}])" for p in range(LOW_BITS))))
                  for w in range(LONGS)), F.lit(0))
    chance = 1.0 / (1 << LOW_BITS)
    return ((1 - differ / float(PERMS)) - chance) / (1 - chance)


def _confirm(threshold_num: int, threshold_den: int):
    def run(batches):
        last_text, last = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            keep = []
            for i in range(len(a)):
                if last_text is None or tb[i] != last_text:
                    last_text, last = tb[i], shingle_set(tb[i])
                x = shingle_set(ta[i])
                both = len(np.intersect1d(x, last, assume_unique=True))
                if threshold_den * both >= threshold_num * (len(x) + len(last) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())),
                                              batch.column(1).take(pa.array(keep, pa.int32()))], names=["u", "v"])
    return run


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets reach the threshold; ``texts`` is ``(doc_id, text)``."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    full = pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "tu", "tv")
    return full.mapInArrow(_confirm(NUM, DEN), "u long, v long")


_CHANCE = 1 / (1 << LOW_BITS)
_MOST = int((1 - (KEEP_FROM * (1 - _CHANCE) + _CHANCE)) * PERMS)  # differing minima of a pair that is still likely
_FAR = PERMS + 1


def _differ(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing minima between each row of ``sig`` and the signature ``one``."""
    x = np.bitwise_or.reduce((sig ^ one).reshape(len(sig), LOW_BITS, LONGS), axis=1)
    return np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int32)


def _forest(ids, comps, sig):
    """Pairs that join the components of a block along the highest estimates (Prim's algorithm over likely pairs).

    Members of one component count as joined already, so n members give at most n - 1 pairs.
    """
    if (comps == comps[0]).all():
        return
    rest = np.arange(1, len(ids))
    near = np.full(len(rest), _FAR, np.int32)
    via = np.zeros(len(rest), np.int64)
    i = 0
    while len(rest):
        d = _differ(sig[rest], sig[i])
        d[d > _MOST] = _FAR
        d[comps[rest] == comps[i]] = -1
        closer = d < near
        near[closer] = d[closer]
        via[closer] = i
        at = int(np.argmin(near))
        i = int(rest[at])
        if 0 <= near[at] < _FAR:
            yield int(max(ids[i], ids[via[at]])), int(min(ids[i], ids[via[at]]))
        rest, near, via = (np.delete(x, at) for x in (rest, near, via))


def _pairs_of_block(ids, comps, sig, side, size, common, bands, band, mode):
    """Likely pairs across components within a block (side all 0) or between its two sides.

    ``tree``: those of a spanning forest; ``ids``: each member that has one, paired with itself;
    ``all``: every pair whose first shared band is ``band`` and that may still reach the threshold given
    how many shingles its members share with any other likely member.
    """
    if mode == "tree":
        yield from _forest(ids, comps, sig)
        return
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    alone = not len(right)
    named = np.zeros(len(ids), bool)
    for i in left:
        j = left[left > i] if alone else right
        j = j[comps[j] != comps[i]]
        if mode == "ids" and named[i]:
            j = j[~named[j]]
        if mode == "all":
            most = np.minimum(common[j], common[i])
            j = j[DEN * most >= NUM * (size[j] + size[i] - most)]
        if not len(j):
            continue
        j = j[_differ(sig[j], sig[i]) <= _MOST]
        if mode == "ids":
            named[j] = True
            named[i] |= len(j) > 0
            continue
        j = j[np.argmax(bands[j] == bands[i], axis=1) == band]
        for k in j:
            yield int(max(ids[i], ids[k])), int(min(ids[i], ids[k]))
    for k in np.flatnonzero(named):
        yield int(ids[k]), int(ids[k])


def _across(mode: str):
    """Rows (key, bi, bj, side, id, comp, band, sig, size, common, bands) sorted by pair of blocks -> pairs."""
    def emit(rows):
        if len(rows) > 1:
            _, _, _, side, ids, comps, band, sig, size, common, bands = zip(*rows)
            yield from _pairs_of_block(np.array(ids), np.array(comps), np.array(sig, np.int64), np.array(side),
                                       np.array(size), np.array(common), np.array(bands, np.int64), band[0], mode)

    def run(batches):
        held, at = [], None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    out += emit(held)
                    held, at = [], row[:3]
                held.append(row)
            yield _edges(out)
        yield _edges(list(emit(held)))
    return run


def _edges(pairs):
    u, v = zip(*set(pairs)) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the confirmed ``links``: components of the graph of labels, which shrinks from call to call."""
    of_u = labels.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
    of_v = labels.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    graph = links.join(of_u, "u").join(of_v, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(graph).select(F.col("id").alias("comp"), "component")
    return save(labels.join(merged, "comp", "left").select(
        "id", F.coalesce("component", "comp").alias("comp")), "minhash-labels")


def _across_components(bucket: DataFrame, labels: DataFrame, reps: DataFrame, mode: str) -> DataFrame:
    """Likely pairs between members of different components that share a bucket.

    Buckets are cut into blocks of about ``BLOCK`` members, and a group of rows
    is one pair of blocks (for ``tree`` one block).  ``reps`` is ``(id, sig,
    size, common, bands)``; members that it doesn't hold are left out.
    """
    labelled = bucket.select("key", "band", "id", "n").join(labels, "id")
    # written first: a join with a bare exchange on both sides lets Spark split a hot bucket
    mixed = save(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
                 .select("key"), "minhash-mixed")
    members = (labelled.join(mixed, "key")
               .withColumn("nb", F.ceil(F.col("n") / float(BLOCK)).cast("int"))
               .withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("nb")).cast("int"))
               .join(reps.select("id", "sig", "size", "common", "bands"), "id"))
    if mode == "tree":
        spread = members.select("*", F.col("b").alias("bi"), F.col("b").alias("bj"), F.lit(0).alias("side"))
    else:
        spread = members.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(
            F.least("b", o).alias("bi"), F.greatest("b", o).alias("bj"),
            F.when(F.col("b") <= o, 0).otherwise(1).alias("side")))).alias("p")).select(
            *members.columns, "p.bi", "p.bj", "p.side")
    return (spread.select("key", "bi", "bj", "side", "id", "comp", "band", "sig", "size", "common", "bands")
            .repartition(F.col("key"), F.col("bi"), F.col("bj"))
            .sortWithinPartitions("key", "bi", "bj", "side", "id")
            .mapInArrow(_across(mode), "u long, v long").distinct())


def _shingles(batches):
    for batch in batches:
        for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            s = shingle_set(text).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), did, np.int64)), pa.array(s),
                                              pa.array(np.full(len(s), len(s), np.int64))], names=["id", "s", "n"])


def _shared_shingles(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, size, common)``: a document's shingles, and those that another document of ``ids`` holds too.

    Repeated rows count once.  Unlike texts of one id: the smallest size, and at least the shared shingles of each,
    so that no pair of them is ruled out wrongly.
    """
    some = texts.join(ids.select(F.col("u").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"])
    rows = save(some.select("doc_id", "text").mapInArrow(freeing(_shingles), "id long, s long, n long"), "minhash-shingles")
    alone = rows.groupBy("s").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last").groupBy(
        "id").agg(F.count(F.lit(1)).alias("alone"))
    size = rows.groupBy("id").agg(F.min("n").alias("size"), F.count(F.lit(1)).alias("total"))
    return size.join(alone, "id", "left").select("id", "size", (F.col("total") - F.coalesce("alone", F.lit(0))).alias("common"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = save(docs.mapInArrow(freeing(_signatures), "doc_id long, n_shingles long, set_hi long, set_lo long, "
                                             "sig array<long>, bands array<long>"), "minhash-sigs")
    key = ["set_hi", "set_lo"]
    full = sigs.where("n_shingles > 0 and doc_id is not null")
    # written first, here and below: a join with a bare exchange on both sides lets Spark split a hot key
    classes = save(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    member = save(full.select("doc_id", *key).join(classes, key).select("doc_id", "rep"), "minhash-members").distinct()
    reps = save(full.select("doc_id", "sig", "bands").join(
        member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("id"), "sig", "bands"), "minhash-reps")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = save(rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"),
                  "minhash-shared")
    bucket = save(rows.join(shared, "key"), "minhash-buckets")
    texts = save(docs.join(bucket.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
                 .select("doc_id", "text"), "minhash-texts")
    first = bucket.groupBy("id").agg(F.min("pivot").alias("v")).where("id <> v")
    star = (first.select(F.col("id").alias("u"), "v")
            .join(reps.select(F.col("id").alias("u"), F.col("sig").alias("su")), "u")
            .join(reps.select(F.col("id").alias("v"), F.col("sig").alias("sv")), "v")
            .where(estimate("su", "sv") >= KEEP_FROM).select("u", "v"))
    labels = bucket.select("id").distinct().select("id", F.col("id").alias("comp"))
    labels = _merge(labels, confirm(star, texts))
    bare = reps.select("id", "sig", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("common"),
                       F.array().cast("array<long>").alias("bands"))
    for r in range(ROUNDS):
        found = _across_components(bucket.where(F.col("band") % 4 == r), labels, bare, "tree")
        labels = _merge(labels, confirm(found, texts))
    # what is still apart: every likely pair, less those whose own shingles rule them out
    facts = save(_shared_shingles(_across_components(bucket, labels, bare, "ids"), texts), "minhash-facts")
    labels = _merge(labels, confirm(_across_components(bucket, labels, reps.join(facts, "id"), "all"), texts))
    named_docs = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("comp", "rep").alias("c"))
    out = sigs.select("doc_id", "n_shingles").join(
        named_docs.groupBy("doc_id").agg(F.min("c").alias("c")), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"),
                      F.coalesce(F.coalesce("c", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
