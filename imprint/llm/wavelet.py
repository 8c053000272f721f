"""Token ids as wavelet matrices, one compressed file per shard (operator 8).

Ids are 16-bit; a shard's matrix is 16 bit planes, most significant first, each
followed by a stable split of the sequence into zeros and ones.  A plane holds a
count of ones before every 512 bits, so ``access``, ``rank`` (how often an id
occurs before a place) and ``select`` (where it occurs the k-th time) read a few
bytes per plane.  The file is a header and the zstd-compressed planes.

Documents are dealt by ranges of doc_id and, among rows of one id, of place in the input,
and sorted; each task encodes its range and closes a shard about every ``SHARD_TOKENS`` ids (a longer document is a shard of its
own), so files hold ascending ids and memory is bounded.  A file is one row of a
Parquet table in the shared folder, written by Spark's commit protocol: a task that
is lost leaves nothing, and a retry writes the same bytes.  Places of a document in the
whole corpus come from sums per range, of which there are as many as partitions.

Defined cases: null text is empty and gets the end id only; null doc_ids come first;
rows of one doc_id (or none) keep the order of the input, which is to be a table's scan
(save what comes from a shuffle first); other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import save
from imprint.llm.words import blocks, coder

BITS, WORD = 16, 512
SHARD_TOKENS = 1 << 20
END_ID = 2
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint16)


class WaveletMatrix:
    """A sequence of 16-bit ids as bit planes with rank and select."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.counts = n, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        x = np.ascontiguousarray(ids, np.uint16)
        zeros, planes, counts = [], [], []
        for level in range(BITS):
            bit = (x >> np.uint16(BITS - 1 - level)) & np.uint16(1) != 0
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            words = np.zeros(-(-len(plane) // (WORD // 8)) * (WORD // 64), "<u8")
            words.view(np.uint8)[: len(plane)] = plane
            ones = np.bitwise_count(words).reshape(-1, WORD // 64).sum(axis=1, dtype=np.uint32)
            counts.append(np.append(np.uint32(0), np.cumsum(ones, dtype=np.uint32)))
            if level < BITS - 1:
                x = np.concatenate([x[~bit], x[bit]])
            zeros.append(len(bit) - int(counts[-1][-1]))
        return cls(len(ids), zeros, planes, counts)

    def ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // WORD
        plane = self.planes[level]
        total = int(self.counts[level][block]) + int(_POP[plane[block * WORD // 8 : i // 8]].sum())
        return total + (bin(int(plane[i // 8]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(BITS):
            bit = int(self.planes[level][i // 8]) >> (i % 8) & 1
            one = self.ones(level, i)
            i = self.zeros[level] + one if bit else i - one
            value = value << 1 | bit
        return value

    def _path(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self.ones(level, lo), self.ones(level, hi)
            one = token >> (BITS - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first ``i`` ids."""
        lo, hi = self._path(token, 0, i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of ``token``; -1 if there is none."""
        lo, hi = self._path(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            a, b = 0, self.n  # smallest b with want + 1 such bits among the first b
            while a < b:
                m = (a + b) // 2
                c = self.ones(level, m + 1)
                if (c if one else m + 1 - c) > want:
                    b = m
                else:
                    a = m + 1
            i = a
        return i

    def tokens(self) -> np.ndarray:
        """All ids, rebuilt from the planes."""
        x = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            y = np.empty_like(x)
            y[~bit] = x[: self.zeros[level]]
            y[bit] = x[self.zeros[level] :] | np.uint16(1 << (BITS - 1 - level))
            x = y
        return x


def write_shard(start: int, docs: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """File: magic, first id's place in its range, documents, their ids, their sizes, and the matrix."""
    m = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in docs], np.uint8)
    body = b"".join([known.tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(),
                     np.array(sizes, "<i8").tobytes(), np.array(m.zeros, "<i8").tobytes(),
                     *(c.astype("<u4").tobytes() for c in m.counts), *(p.tobytes() for p in m.planes)])
    return struct.pack("<4sqqq", b"WMX1", start, len(docs), m.n) + zstandard.ZstdCompressor(level=1).compress(body)


def read_shard(data: bytes) -> tuple[int, list, np.ndarray, WaveletMatrix]:
    """(first place, doc ids, sizes, matrix) of a shard file."""
    magic, start, n_docs, n = struct.unpack_from("<4sqqq", data)
    if magic != b"WMX1":
        raise ValueError("not a wavelet shard")
    body = zstandard.ZstdDecompressor().decompress(data[struct.calcsize("<4sqqq") :])
    at = 0

    def take(dtype, count):
        nonlocal at
        a = np.frombuffer(body, dtype, count, at)
        at += a.nbytes
        return a

    known, docs, sizes = take(np.uint8, n_docs), take("<i8", n_docs), take("<i8", n_docs)
    zeros = take("<i8", BITS).tolist()
    blocks_ = -(-(-(-n // 8)) // (WORD // 8)) + 1
    counts = [take("<u4", blocks_) for _ in range(BITS)]
    planes = [take(np.uint8, -(-n // 8)) for _ in range(BITS)]
    return start, [d if k else None for d, k in zip(docs.tolist(), known)], sizes, WaveletMatrix(n, zeros, planes, counts)


_SHARD_SQL = "part int, shard int, n_docs long, n_tokens long, data binary"


def _write(path: str | None, end_id: int, shard_tokens: int):
    def run(batches):
        words, part = coder(path), TaskContext.get().partitionId()
        start = shard = 0
        docs, sizes, ids, held = [], [], [], 0

        def close():
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(docs)], pa.int64()),
                 pa.array([len(flat)], pa.int64()), pa.array([write_shard(start, docs, sizes, flat)], pa.binary())],
                names=["part", "shard", "n_docs", "n_tokens", "data"])

        end = np.array([end_id], np.uint16)
        for batch in batches:
            dids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in blocks(texts):
                for did, x in zip(dids[lo:hi], words.encode([t or "" for t in texts[lo:hi]])):
                    if held and held + len(x) + 1 > shard_tokens:
                        yield close()
                        start, shard = start + held, shard + 1
                        docs, sizes, ids, held = [], [], [], 0
                    docs.append(did)
                    sizes.append(len(x) + 1)
                    ids += (x, end)
                    held += len(x) + 1
        if docs:
            yield close()
    return run


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID, parts: int | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into shard files, and return their table."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parts, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    return save(dealt.select("doc_id", "text").mapInArrow(_write(path, end_id, shard_tokens), _SHARD_SQL), "wavelet-shards")


def _read(batches):
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            start, docs, sizes, m = read_shard(data.as_buffer().to_pybytes())
            ids = m.tokens().astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(base + start + ends - sizes), pa.array(sizes),
                 pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the shard files."""
    per = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return shards.join(F.broadcast(before), "part").select("base", "data").mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
