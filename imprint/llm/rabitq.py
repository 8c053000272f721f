"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 2).

Index: vectors are centred on the corpus mean, scaled to unit length, put into ``BITS`` times as many dimensions by
one random orthogonal matrix and cut to the signs of their coordinates: packed bits and two correction scalars per
row (distance from the centre; inner product of the unit vector with its code).  Every row is indexed; the mean
covers all rows.

Search, in groups of a block of rows and some of the queries.  A query's rotated unit vector is quantised to
``PLANES`` bits a coordinate, as many bit planes; its inner product with a code is estimated by AND and bit counts,
corrected by the scalars, and an error bound of ``eps`` standard deviations gives each row a smallest and a largest
possible distance.

1. Only codes travel.  Each group gives the k least largest distances of each query; the k-th least of all of
   them bounds what can be among a query's k nearest, over the whole corpus.
2. Rows whose smallest distance is within a query's bound are reranked exactly on the original vectors, which
   travel with their codes once per group of queries; the k best of all groups are the result.

A row that is left out wrongly needs an error beyond ``eps`` standard deviations.  Recall and the share of rows
reranked (``n_reranked``) are measured in the tests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as rows or as
queries; a shorter vector counts as filled up with zeros; a query never finds rows with its own id; a query id that
occurs repeatedly searches with its least vector, as rows repeated ids count each; rows without id are found,
after all ids on ties, and never ask; ties go to the smaller id; squares beyond double precision are scaled down,
where only they would be infinite.  Empty table: no rows; fewer than k others: all.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import save

EPS, SEED = 1.9, 12345
BITS = 4  # code bits a dimension
PLANES = 6
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
NO_ID = np.iinfo(np.int64).max


def rotation(dim: int, seed: int = SEED, bits: int = BITS) -> np.ndarray:
    """``dim`` orthonormal rows in ``bits`` times as many dimensions, rounded up to whole words of code."""
    size = -(-dim * bits // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros to ``dim``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    size = np.asarray(pa.compute.list_value_length(vectors)).astype(np.int64)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _units(v: np.ndarray, centre: np.ndarray, turn: np.ndarray, scale: float):
    """(distance from the centre, rotated unit vectors), in units of ``scale``."""
    x = v / scale - centre
    norm = np.sqrt((x * x).sum(axis=1))
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    return norm, unit @ turn


def codes(v: np.ndarray, centre: np.ndarray, turn: np.ndarray, scale: float = 1.0):
    """(packed signs as 64-bit words, distance from the centre, inner product of unit vector and code)."""
    norm, u = _units(v, centre, turn, scale)
    return np.packbits(u > 0, axis=1).view(np.uint64), norm, np.abs(u).sum(axis=1) / np.sqrt(turn.shape[1])


class Block:
    """Codes and scalars of some rows; bounds on their squared distances from a query."""

    def __init__(self, code: np.ndarray, norm: np.ndarray, ip: np.ndarray, eps: float):
        self.words, self.norm = np.ascontiguousarray(code.T), norm
        self.ones = sum(np.bitwise_count(w).astype(np.int64) for w in self.words)
        self.bits = 64 * len(self.words)
        self.safe = np.where(ip > 0, ip, 1.0)
        self.error = eps * np.sqrt(np.maximum(0.0, 1 - self.safe**2)) / (self.safe * np.sqrt(max(1, self.bits - 1))) + 1e-5

    def bounds(self, q: np.ndarray, q_norm: float):
        """(smallest, largest) squared distance for the rotated unit vector ``q``."""
        least = float(q.min())
        step = max((float(q.max()) - least) / ((1 << PLANES) - 1), 1e-30)
        level = np.rint((q - least) / step).astype(np.int64)
        total = np.zeros(len(self.norm), np.int64)
        for j in range(PLANES):
            plane = np.packbits(level >> j & 1).view(np.uint64)
            total += sum(np.bitwise_count(w & p).astype(np.int64) for w, p in zip(self.words, plane)) << j
        whole = least * self.bits + step * int(level.sum())
        inner = (2 * (least * self.ones + step * total) - whole) / np.sqrt(self.bits)
        rounding = 3 * step / np.sqrt(12)
        mid, error = inner / self.safe, self.error + rounding / self.safe
        base, dev = self.norm**2 + q_norm**2, 2 * self.norm * q_norm
        return base - dev * (mid + error), base - dev * (mid - error)


def exact(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    with np.errstate(over="ignore"):
        diff = rows - q
        out = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1]) if len(rows) else np.empty(0)
        for i in np.flatnonzero(~np.isfinite(out)):
            most = np.abs(diff[i]).max()
            out[i] = most * np.sqrt(np.sum((diff[i] / most) ** 2)) if np.isfinite(most) else np.inf
    return out


def _index(centre, turn, scale):
    def run(batches):
        for batch in batches:
            bits, norm, ip = codes(_matrix(batch.column(1), len(centre)), centre, turn, scale)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2), pa.array([b.tobytes() for b in bits], pa.binary()),
                pa.array(norm), pa.array(ip)], names=["vec_id", "v", "asks", "code", "norm", "ip"])
    return run


def build_index(vectors: DataFrame, is_query) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """Index table ``(vec_id, v, asks, code, norm, ip)`` of ``vectors(vec_id, embedding)``, centre, rotation, scale."""
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                         F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("asks"))
    good = save(raw.where("v is not null and exists(v, x -> x <> 0) and "
                          "not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"), "ann-vectors")
    facts = good.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    dim, scale = facts["dim"] or 1, facts["most"] or 1.0
    mean = good.agg(*[F.avg(F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)) / F.lit(scale)).alias(f"c{i}")
                      for i in range(dim)]).first()
    centre, turn = np.array([x or 0.0 for x in mean]), rotation(dim)
    return save(good.mapInArrow(_index(centre, turn, scale), "vec_id long, v array<double>, asks boolean, code binary, "
                                                             "norm double, ip double"), "ann-index"), centre, turn, scale


def _group(centre, turn, scale, k, eps, rerank):
    """A block of rows (kind 0) and queries (kind 1) -> the k least upper bounds, or the k nearest, of each query."""
    def run(key, table):
        table = table.combine_chunks()
        kind = table.column("kind").to_numpy()
        rows, asked = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if rows.num_rows and asked.num_rows:
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            block = Block(code, rows.column("norm").to_numpy(), rows.column("ip").to_numpy(), eps)
            ids, own = rows.column("id").fill_null(NO_ID).to_numpy(), asked.column("id").to_numpy()
            q = _matrix(asked.column("v").combine_chunks(), len(centre))
            q_norm, unit = _units(q, centre, turn, scale)
            limit = asked.column("bound").to_numpy(zero_copy_only=False)
            v = _matrix(rows.column("v").combine_chunks(), len(centre)) if rerank else None
            for j in range(len(own)):
                low, high = block.bounds(unit[j], q_norm[j])
                others = ids != own[j]
                if not rerank:
                    best = np.sort(np.partition(high[others], k - 1)[:k] if others.sum() > k else high[others])
                    out.append((np.full(len(best), own[j]), np.full(len(best), NO_ID), best, np.zeros(len(best), np.int64)))
                    continue
                some = np.flatnonzero(~(low > limit[j]) & others)
                distance = exact(v[some], q[j])
                best = np.lexsort((ids[some], distance))[:k]
                count = np.zeros(len(best), np.int64)
                count[:1] = len(some)
                out.append((np.full(len(best), own[j]), ids[some][best], distance[best], count))
        query, found, score, count = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": query, "vec_id": pa.array(found, mask=found == NO_ID), "score": score,
                         "reranked": count})
    return run


_FOUND = "query_id long, vec_id long, score double, reranked long"


def search(vectors: DataFrame, is_query, k: int = 10, eps: float = EPS, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score, n_reranked)``: the k nearest rows of each row of ``vectors`` that ``is_query``."""
    index, centre, turn, scale = build_index(vectors, is_query)
    queries = save(index.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    blocks, groups = 1 + index.count() // block_rows, 1 + queries.count() // query_rows
    unique = F.xxhash64("vec_id", "v")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def group(asked, rerank):
        none = F.lit(None).cast("array<double>")
        rows = index.select(F.pmod(unique, F.lit(blocks)).cast("int").alias("b"), every(groups).alias("g"),
                            F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("v") if rerank else none.alias("v"),
                            "code", "norm", "ip", F.lit(None).cast("double").alias("bound"))
        asked = asked.select(every(blocks).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"),
                             F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("binary").alias("code"),
                             F.lit(None).cast("double").alias("norm"), F.lit(None).cast("double").alias("ip"), "bound")
        return rows.unionByName(asked).groupBy("b", "g").applyInArrow(
            _group(centre, turn, scale, k, eps, rerank), _FOUND)

    first = group(queries.withColumn("bound", F.lit(float("inf"))), False)
    bound = save(first.groupBy("query_id").agg(F.sort_array(F.collect_list("score")).alias("all")).select(
        F.col("query_id").alias("vec_id"), F.when(F.size("all") >= k, F.element_at("all", k)).otherwise(
            F.lit(float("inf"))).alias("bound")), "ann-bounds")
    found = group(queries.join(bound, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), True)
    whole = Window.partitionBy("query_id")
    return found.withColumn("rank", F.row_number().over(whole.orderBy("score", F.asc_nulls_last("vec_id")))).withColumn(
        "n_reranked", F.sum("reranked").over(whole)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score", "n_reranked")
