"""Repeated byte windows by depth-limited radix passes over suffixes, by hashed digits (operator 6).

Digits are hashed, so groups are as a sort would make them, but in no order: only equal
groups matter.  Every byte covered by a 200-byte string that starts at two or more places of the
corpus is removed.  Suffixes need to be ordered only through 200 bytes, most
significant digit first, and a pass drops every suffix that is alone in its group:

  digit 1  32 bytes.  Equal windows hold the same smallest (hashed) 32-byte string
           at the same place, so the windows of a text fall into short runs that
           share that anchor, and one row per run (about 1 in 85 bytes) stands for
           all of them.  Runs whose anchor occurs once are unique: dropped.  Equal
           runs are repeated in full: done, nothing expanded.
  digit 2  185 bytes.  Where an anchor group still splits, one run of each class is
           cut into blocks of 16 windows, aligned to the anchor, which share 185
           bytes; again unique blocks go and equal blocks are done.
  digit 3  200 bytes: one block of each class of a group that still splits is cut
           into its windows, and equal windows are the repeated ones.

Each pass is a partial aggregate and an equi-join in Spark, so a passage held by a
third of the corpus costs one row per task and class.  Groups are compared by two
independent 64-bit hashes (the digit's and the whole piece's).  Only texts that need expansion or cutting are shuffled; they are
picked with a bitmap of a fixed number of bits (a filter; the join stays exact).

Defined cases: null text is empty; texts under 200 bytes are never cut; null
doc_id and repeated rows are documents like others (a row is known by 128 bits of
hashes of its id and text, nulls apart).  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import mark, mix64, save

WINDOW, GRAM, BLOCK = 200, 32, 16
CHUNK = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_C = np.random.default_rng(77).integers(0, 2**63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position of ``buf`` (uint8)."""
    n = len(buf) - GRAM + 1
    words = np.zeros(len(buf) - 7, np.uint64)
    for k in range(8):
        words |= buf[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    h = words[:n] * _C[0]
    for k in range(1, GRAM // 8):
        h += mix64(words[8 * k : 8 * k + n]) * _C[k] if k == 1 else words[8 * k : 8 * k + n] * _C[k]
    return mix64(h)


def runs(buf: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Runs of windows with one anchor in the documents ``buf[start:end]``.

    Returns (document, first window, number of windows, anchor, anchor hash) arrays.
    """
    total = len(buf)
    if total < WINDOW:
        z = np.empty(0, np.int64)
        return z, z, z, z, np.empty(0, np.uint64)
    valid = np.zeros(total + 1, np.int8)
    long = end - start >= WINDOW
    np.add.at(valid, start[long], 1)
    np.add.at(valid, end[long] - WINDOW + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    per = WINDOW - GRAM + 1
    firsts, counts, hashes, anchors = [], [], [], []
    for at in range(0, total - WINDOW + 1, CHUNK):
        stop = min(at + CHUNK, total - WINDOW + 1)
        h = gram_hashes(buf[at : stop + WINDOW - 1])
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        size = 1
        m = key
        while size * 2 <= per:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < per:
            m = np.minimum(m[: len(m) - (per - size)], m[per - size :])
        anchor = (m & _POS).astype(np.int64)
        ok = valid[at:stop]
        change = np.ones(len(anchor), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])
        where = np.flatnonzero(change)
        length = np.diff(np.append(where, len(anchor)))
        keep = ok[where]
        anchors.append(anchor[where[keep]] + at)
        firsts.append(where[keep] + at)
        counts.append(length[keep])
        hashes.append(h[anchor[where[keep]]])
    first, count, hashed = np.concatenate(firsts), np.concatenate(counts), np.concatenate(hashes)
    return np.searchsorted(start, first, side="right") - 1, first, count, np.concatenate(anchors), hashed


def _flat(texts):
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    return b"".join(raw), ends - np.array([len(r) for r in raw], np.int64), ends


def _hashes(data: bytes, firsts, sizes) -> np.ndarray:
    view, one = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((one(view[f : f + n]) for f, n in zip(firsts.tolist(), sizes.tolist())), np.uint64,
                       len(firsts)).view(np.int64)


def _parts(batch, limit=1 << 23):
    """Row ranges of a batch whose texts hold about ``limit`` bytes (a longer text stands alone)."""
    size = np.asarray([len(t or "") for t in batch], np.int64)
    edge = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(edge)) + 1
    return zip([0, *cuts], [*cuts, len(size)])


def _runs(batches):
    for batch in batches:
        did, th, texts = batch.column(0).to_numpy(False), batch.column(1).to_numpy(False), batch.column(2).to_pylist()
        for lo, hi in _parts(texts):
            data, start, end = _flat(texts[lo:hi])
            # two documents never share a start unless one is empty; empty ones hold no window
            full = end > start
            idx = np.flatnonzero(full)
            doc, first, count, anchor, fp = runs(np.frombuffer(data, np.uint8), start[full], end[full])
            rows = idx[doc] + lo if len(doc) else np.empty(0, np.int64)
            base = start[full][doc] if len(doc) else np.empty(0, np.int64)
            yield _pieces(fp.view(np.int64), _hashes(data, first, count + WINDOW - 1), did[rows], th[rows],
                          first - base, count, anchor - first, np.ones(len(first), np.int64))


PIECE = pa.schema([("g", pa.int64()), ("s", pa.int64()), ("did", pa.int64()), ("th", pa.int64()),
                   ("first", pa.int32()), ("n", pa.int16()), ("o", pa.int16()), ("w", pa.int64())])
_PIECE_SQL = "g long, s long, did long, th long, first int, n short, o short, w long"


def _pieces(*columns):
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, PIECE)],
                                      schema=PIECE)


def _finer(step: int):
    """(did, th, text, open pieces) -> pieces of at most ``step`` windows, aligned to the anchor.

    ``o`` is the distance from a piece's first window to its anchor.  The digit g is the hash of the
    bytes that every window of the (full) aligned block holds.
    """
    def run(batches):
        for batch in batches:
            did, th, texts, lists = (batch.column(k).to_pylist() for k in range(4))
            for i in range(len(texts)):
                raw = (texts[i] or "").encode("utf-8", "surrogatepass")
                todo = lists[i]
                size = np.array([x["n"] for x in todo])
                run_of = np.repeat(np.arange(len(todo)), size)
                step_in = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                p = np.array([x["first"] for x in todo])[run_of] + step_in
                o = np.array([x["o"] for x in todo])[run_of] - step_in
                block = o // step
                new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (run_of[1:] != run_of[:-1])))
                n = np.diff(np.append(new, len(p)))
                first, off = p[new], o[new]
                core = first + off - block[new] * step  # the last start that an aligned block can have
                g = _hashes(raw, core, np.full(len(new), WINDOW - step + 1))
                # blocks at unlike distances from the anchor are unlike groups
                g = mix64(g.view(np.uint64) + block[new].astype(np.uint64) * _C[0]).view(np.int64)
                yield _pieces(g, _hashes(raw, first, n + WINDOW - 1), np.full(len(new), did[i]),
                              np.full(len(new), th[i]), first, n, off,
                              np.array([x["w"] for x in todo])[run_of[new]])
    return run


def cut_spans(raw: bytes, starts) -> tuple[bytes, int, int]:
    """Remove ``[first, first + n + WINDOW - 1)`` of each run: kept bytes, number removed, number of spans."""
    edge = np.zeros(len(raw) + 1, np.int32)
    for x in starts:
        edge[x["first"]] += 1
        edge[x["first"] + x["n"] + WINDOW - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
    return kept, int(gone.sum()), spans


def _cut(batches):
    for batch in batches:
        did, th, texts, lists = (batch.column(k).to_pylist() for k in range(4))
        out = [cut_spans((t or "").encode("utf-8", "surrogatepass"), x) for t, x in zip(texts, lists)]
        yield pa.RecordBatch.from_arrays([
            pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array([x[0] for x in out], pa.binary()),
            pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
            names=["did", "th", "kept", "n_removed", "n_spans"])


def only_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows that may be in ``marked``: a filter without misses; the caller joins exactly."""
    return mark(docs, marked, ["did", "th"]).where("_marked").drop("_marked")


def _key():
    """A row's key: 128 bits of its id and text, nulls apart from all values."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").isNull(), F.col("text").cast("string")]
    return [F.xxhash64(F.lit(17), *parts).alias("did"), F.xxhash64(F.lit(29), *parts).alias("th")]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*_key(), F.col("text").cast("string").alias("text"))


def _pass(pieces: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One digit: the single pieces that are repeated in full, and one piece of each class of a split group."""
    # written first: a join with a bare exchange on both sides lets Spark split a hot group
    often = save(pieces.groupBy("g").agg(F.sum("w").alias("c")).where("c > 1").select("g"), f"{name}-often")
    some = save(pieces.join(often, "g"), f"{name}-shared")
    classes = save(some.groupBy("g", "s").agg(F.sum("w").alias("w"), F.min(F.struct("did", "th", "first", "n", "o")).alias(
        "at")), f"{name}-classes")
    whole = some.where("w = 1").join(classes.where("w > 1").select("g", "s"), ["g", "s"]).select(
        "did", "th", "first", F.col("n").cast("int").alias("n"))
    split = classes.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g")
    return whole, save(classes.join(split, "g").select("at.*", "w"), f"{name}-open")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(did, th, first, n)``: runs of window starts that are repeated."""
    keys = keyed(docs)
    found, todo = _pass(save(keys.mapInArrow(_runs, _PIECE_SQL), "runs"), "runs")
    for step in (BLOCK, 1):
        lists = todo.groupBy("did", "th").agg(F.collect_list(F.struct("first", "n", "o", "w")).alias("todo"))
        text = only_marked(keys, todo).dropDuplicates(["did", "th"]).join(lists, ["did", "th"])
        pieces = save(text.select("did", "th", "text", "todo").mapInArrow(_finer(step), _PIECE_SQL), f"pieces-{step}")
        whole, todo = _pass(pieces, f"pieces-{step}")
        found = found.unionByName(whole)
    return save(found, "runs-repeated")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)``.

    ``kept`` holds the bytes left of a document that was cut (null where nothing was removed).
    """
    found = repeated_runs(docs)
    lists = found.groupBy("did", "th").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    keys = keyed(docs)
    cut = only_marked(keys, found).dropDuplicates(["did", "th"]).join(lists, ["did", "th"]).select(
        "did", "th", "text", "runs").mapInArrow(_cut, "did long, th long, kept binary, n_removed long, n_spans long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *_key(), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = cut.withColumn("cut_sha", F.sha2("kept", 256))
    return rows.join(cut, ["did", "th"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), "kept",
        F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same figures by a dictionary of all windows, for tests on small tables."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for p in range(len(r) - WINDOW + 1):
            seen[r[p : p + WINDOW]] = seen.get(r[p : p + WINDOW], 0) + 1
    out = []
    for r in raw:
        hit = [{"first": p, "n": 1} for p in range(len(r) - WINDOW + 1) if seen[r[p : p + WINDOW]] > 1]
        kept, gone, spans = cut_spans(r, hit)
        out.append((len(r), gone, spans, hashlib.sha256(kept).hexdigest()))
    return out
