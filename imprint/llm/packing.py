"""Sequence packing by minimum bin slack (operator 9).

A document's ids and an end id are cut into pieces of ``CAPACITY`` only if longer.  A
full piece is a sequence of its own.  The others count only through their length, so the
plan is made from the histogram of lengths, which has fewer than ``CAPACITY`` rows however
large the corpus: for each bin the longest length left is taken, a bitset subset-sum over
the lengths left (a Python integer, one bit per sum) finds the fullest combination beside
it, and the pattern is removed as often as the counts allow.

Pieces find their place by their rank among those of their length.  Ranks come from running
numbers per task and the sums of the tasks before, so a length that a third of all pieces
share is dealt over all tasks.

Defined cases: null text is empty, one end id; rows of one doc_id are packed each; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import save
from imprint.llm.words import blocks, coder

CAPACITY, END_ID = 2048, 0


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``; longer lengths first on ties."""
    reach, mask, stages = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length) if length <= room else 0
        copies = 1
        while left:
            k = min(copies, left)
            stages.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: Counter = Counter()
    for length, k, before in reversed(stages):
        if not before >> total & 1:
            chosen[length] += k
            total -= length * k
    return dict(chosen)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pattern: length -> copies, bins of that pattern)] that use up the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    bins = []
    while left:
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        pattern = Counter(fullest({n: c for n, c in rest.items() if c}, capacity - top))
        pattern[top] += 1
        times = min(left[n] // k for n, k in pattern.items())
        bins.append((dict(pattern), times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _tables(bins):
    """Per length the plan's rows (first rank, copies per bin, first bin, offset in the bin)."""
    rows: dict[int, list] = {}
    used: Counter = Counter()
    number = 0
    for pattern, times in bins:
        at = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.setdefault(length, []).append((used[length], k, number, at))
            used[length] += k * times
            at += k * length
        number += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


_PIECE_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _cut(path, capacity: int, end_id: int):
    def run(batches):
        words, part, seen = coder(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for batch in batches:
            dids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                rows = []
                for did, x in zip(dids[lo:hi], words.encode([t or "" for t in texts[lo:hi]])):
                    ids = np.concatenate([x.astype("<u4"), end])
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        one = ids[at : at + capacity]
                        rows.append((did, piece, at, len(one), zlib.crc32(one), part, seen[len(one)]))
                        seen[len(one)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                                 pa.int64(), pa.int32(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return run


def _place(tables, full: int, capacity: int):
    def run(batches):
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            number, offset = np.array(rank + full), np.zeros(len(rank), np.int64)
            for n in np.unique(length[length < capacity]).tolist():
                rows = np.flatnonzero(length == n)
                t = tables[n]
                at = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                into = rank[rows] - t[at, 0]
                number[rows] = t[at, 2] + into // t[at, 1]
                offset[rows] = t[at, 3] + into % t[at, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(number), pa.array(offset)], names=[
                "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece with its sequence and place in it."""
    pieces = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  .mapInArrow(_cut(path, capacity, end_id), _PIECE_SQL), "pieces")
    per = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    before = per.select("part", "length", (F.sum("c").over(Window.partitionBy("length").orderBy("part"))
                                           - F.col("c")).alias("before"))
    # fewer than ``capacity`` rows: the driver plans from the histogram alone
    histogram = {r["length"]: r["c"] for r in per.where(F.col("length") < capacity).groupBy("length").agg(
        F.sum("c").alias("c")).collect()}
    bins = plan(histogram, capacity)
    ranked = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(_tables(bins), sum(t for _, t in bins), capacity),
                             "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
                             "offset long")
