"""Exact top-k by inner product: pivot-table elimination over cells of rows.

Components become ``floor(SCALE * x)`` (x as double), so scores are integers.  With M the largest norm, a row x
gets one more component ``sqrt(M^2 - |x|^2)`` and a query q a zero: then ``2 <q, x> = |q|^2 + M^2 - d(q, x)^2``,
and the largest inner product is the smallest distance, to which the triangle inequality applies.

The pivot table holds the distances of every row to ``PIVOTS`` pivots, in steps of ``STEP`` M, and the greatest
``|d(q, p) - d(x, p)|`` over the pivots p, less what the steps round, is a lower bound of ``d(q, x)``.  Pivots are taken from a bounded sample of ``SAMPLE`` rows,
each the one farthest from those before it; they decide how much is eliminated, never the result.

1. Rows are dealt to cells by their nearest of the first pivots, and a cell to blocks of about ``BLOCK`` rows.
   Per cell and pivot the least and the greatest distance are kept (at most PIVOTS^2 rows, broadcast).
2. Every query evaluates one block of the cell with its smallest bound: the k-th best score there is its floor.
3. It is sent to the blocks of every cell whose bound still reaches the floor, in groups of about ``BLOCK`` rows
   and ``QUERIES`` queries.  There the pivot table bounds every row, and rows are evaluated in
   bound order, until the next bound is under the k-th best score known; ties are evaluated.
4. The k best of a query's groups are merged.

A row travels once per group of queries, a query once per block left.  Blocks and groups are as many as the slots
need and the bounds on their size allow; a cell that holds a third of all rows is just more blocks.  Scores are
exact: products in a floating type that holds all sums, in Python's integers beyond 2^53 (a score that no long
holds counts as the nearest one that does).  Where the bounds leave over half of a block to a query, the rest of
it is one matrix product; ``n_evaluated`` counts these rows too.

Defined cases.  Vectors that are null or hold null or non-finite components (scaled) take no part.  A shorter vector
counts as filled up with zeros (an empty one scores 0 with all).  Candidates are all rows but those of the
query's own id; repeated rows are candidates each.  A query id that occurs repeatedly searches with its least
vector (as arrays compare).  Rows without id are candidates, after all ids on ties, and never queries.  Fewer
than k candidates: all.  Empty table or no queries: no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import save

SCALE = 64
PIVOTS = 64
SAMPLE = 4096
BLOCK = (8192, 65_536)  # rows of a block: as many as give every slot some blocks, between these
QUERIES = (256, 4096)  # queries of a group, likewise
AT_ONCE = 1 << 17  # bounds held at once
STEPS = 32_766
STEP = 2 / STEPS
NO_ID = np.iinfo(np.int64).max


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros to ``dim``."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    if len(size) and np.all(size == dim):
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)
    out[row, col] = flat[offsets[0] : offsets[-1]]
    return out


def exact_type(x: np.ndarray, q: np.ndarray):
    """A floating type that holds every inner product of rows of both, and its sums; None if there is none."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else None


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``x`` with ``q``, exact, within the range of long."""
    if exact_type(x, q[None]) is not None:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q.tolist()]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole)), low), high) for row in x.tolist()], np.int64)


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``points``, each the farthest from those before; the first is the farthest from the mean."""
    with np.errstate(all="ignore"):
        far = np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1)) if len(points) else np.empty(0)
        taken = []
        for _ in range(min(n, len(points))):
            i = int(np.nanargmax(far)) if np.isfinite(far).any() else 0
            if taken and not far[i] > 0:
                break
            taken.append(i)
            d = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
            far = d if len(taken) == 1 else np.fmin(far, d)
    return points[taken]


class Table:
    """Pivots in the space with one more component, and distances to them."""

    def __init__(self, pivots: np.ndarray, dim: int, top: float):
        self.dim, self.top, self.cells = dim, top, 1  # top: the largest squared norm of all rows
        self.unit = np.sqrt(top) or 1.0  # of distances
        self.pivots = self._more(pivots)

    def _more(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))[:, None]])

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        points = np.hstack([x, np.zeros((len(x), 1))]) if query else self._more(x)
        out = np.zeros((len(x), len(self.pivots)), np.int16)
        if np.isfinite(self.top):  # else squares are beyond double precision, and distances say nothing
            for i, p in enumerate(self.pivots):
                out[:, i] = np.minimum(np.sqrt(((points - p) ** 2).sum(axis=1)) / (STEP * self.unit), STEPS)
        return out

    def most(self, steps: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The greatest inner product with a query of squared norm ``norm`` if distances to a pivot differ by ``steps``."""
        if not np.isfinite(self.top):
            return np.full(np.broadcast_shapes(steps.shape, norm.shape), np.inf)
        near = np.maximum(steps.astype(np.float64) - 2, 0) * (STEP * self.unit)
        return (norm + self.top - near * near) / 2 + 1e-9 * (norm + self.top) + 1e-6

    def limit(self, floor: float, norm: float) -> int:
        """The most steps with which a row can still reach ``floor``."""
        near = norm + self.top - 2 * floor + 2e-9 * (norm + self.top) + 2e-6
        if not np.isfinite(near):
            return STEPS
        return int(min(np.sqrt(max(near, 0)) / (STEP * self.unit) + 3, STEPS))


def _prepare(t: Table):
    """Rows -> distances to the pivots, and the cell."""
    def run(batches):
        for batch in batches:
            d = t.distances(matrix(batch.column(1), t.dim))
            cell = d[:, : t.cells].argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(
                    pa.list_(pa.int16())), pa.array(cell, pa.int32())], names=["id", "v", "d", "cell"])
    return run


def _ranges(batches):
    """Per batch, cell and pivot the least and the greatest distance."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        cell = batch.column(1).to_numpy()
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
        low, high = np.minimum.reduceat(d[order], first), np.maximum.reduceat(d[order], first)
        n, p = low.shape
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(cell[order][first], p), pa.int32()), pa.array(np.tile(np.arange(p), n), pa.int32()),
             pa.array(low.ravel(), pa.int32()), pa.array(high.ravel(), pa.int32())], names=["cell", "pivot", "low", "high"])


def _cell_bounds(t: Table, low: np.ndarray, high: np.ndarray):
    """Queries -> distances to the pivots and, for every cell, the greatest score that it can hold."""
    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1), t.dim)
            d = t.distances(q, query=True)
            bound, step = np.empty((len(q), len(low)), np.int32), max(1, AT_ONCE // low.size)
            for a in range(0, len(q), step):
                x = d[a : a + step, None].astype(np.int32)
                bound[a : a + step] = np.maximum(low[None] - x, x - high[None]).max(axis=2, initial=0)
            most = t.most(bound, np.square(q).sum(axis=1)[:, None])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]) for a in (d, most)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists[0].cast(pa.list_(pa.int16())),
                 lists[1].cast(pa.list_(pa.float64()))], names=["id", "v", "d", "most"])
    return run


def _best(held, ids: np.ndarray, values: np.ndarray, k: int):
    """The k best of what is held and what is new: greater scores first, ties to the smaller id."""
    if len(held[0]) == k:
        ok = values >= held[1][-1]
        ids, values = ids[ok], values[ok]
    if not len(ids):
        return held
    ids, values = np.r_[held[0], ids], np.r_[held[1], values]
    if len(ids) > 4 * k:
        ok = values >= np.partition(values, len(values) - k)[len(values) - k]
        ids, values = ids[ok], values[ok]
    order = np.lexsort((ids, ~values))[:k]
    return ids[order], values[order]


def _search(t: Table, k: int):
    """A block of rows (role 0) and its queries (role 1) -> the k best of every query, and how many rows it evaluated."""
    def run(key, table):
        table = table.combine_chunks()
        role = table.column("role").to_numpy()
        rows, queries = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        out = {c: [np.empty(0, np.int64)] for c in ("query_id", "vec_id", "score", "evaluated")}
        if len(rows) and len(queries):
            x, q = (matrix(r.column("v").combine_chunks(), t.dim) for r in (rows, queries))
            dx, dq = (r.column("d").combine_chunks().flatten().to_numpy().reshape(len(r), -1) for r in (rows, queries))
            norm, kind = np.square(q).sum(axis=1), exact_type(x, q)
            if kind is not None:
                x, q = x.astype(kind), q.astype(kind)
            ids = rows.column("id").fill_null(NO_ID).to_numpy()
            own, floors = queries.column("id").to_numpy(), queries.column("floor").to_numpy()
            columns, step = np.ascontiguousarray(dx.T), max(1, AT_ONCE // len(x))
            for a in range(0, len(q), step):
                bounds = np.zeros((min(step, len(q) - a), len(x)), np.int16)
                for p, column in enumerate(columns):
                    apart = column[None] - dq[a : a + step, p, None]
                    np.maximum(bounds, np.abs(apart, out=apart), out=bounds)
                some = [_Query(t, k, x, ids, bounds[i - a], q[i], own[i], norm[i], floors[i])
                        for i in range(a, a + len(bounds))]
                for one in some:
                    one.go_on(len(x) // 2 if kind is not None else len(x))
                rest = [one for one in some if len(one.left)]
                if rest:
                    for one, all_scores in zip(rest, (np.stack([one.q for one in rest]) @ x.T).astype(np.int64)):
                        one.take(one.left, all_scores[one.left])
                for one in some:
                    n = len(one.held[0])
                    out["query_id"].append(np.full(n, one.own))
                    out["vec_id"].append(one.held[0])
                    out["score"].append(one.held[1])
                    out["evaluated"].append(np.r_[one.evaluated, np.zeros(n - 1, np.int64)] if n else one.held[0])
        whole = {c: np.concatenate(v).astype(np.int64) for c, v in out.items()}
        return pa.table({"query_id": whole["query_id"], "vec_id": pa.array(whole["vec_id"], mask=whole["vec_id"] == NO_ID),
                         "score": whole["score"], "evaluated": whole["evaluated"]})
    return run


class _Query:
    """One query in a block: the rows left, in bound order, and the k best so far."""

    def __init__(self, t, k, x, ids, bounds, q, own, norm, floor):
        self.t, self.k, self.x, self.ids, self.bounds, self.q, self.own, self.norm = t, k, x, ids, bounds, q, own, norm
        self.floor, self.evaluated = floor, 0
        self.held = np.empty(0, np.int64), np.empty(0, np.int64)
        left = np.flatnonzero((bounds <= t.limit(floor, norm)) & (ids != own))
        self.left = left[np.argsort(bounds[left], kind="stable")]

    def take(self, rows, values):
        self.evaluated += len(rows)
        self.held = _best(self.held, self.ids[rows], values, self.k)
        if len(self.held[0]) == self.k:
            self.floor = max(self.floor, float(self.held[1][-1]))

    def go_on(self, enough: int):
        """Evaluate rows in bound order, until the next bound is too large or a step would take over ``enough`` rows."""
        step = 8 * self.k
        while len(self.left):
            part = self.left[:step]
            self.take(part, scores(self.x[part], self.q))
            self.left = self.left[len(part) :]
            ends = np.searchsorted(self.bounds[self.left], self.t.limit(self.floor, self.norm), side="right")
            self.left, step = self.left[:ends], 4 * step
            if min(step, len(self.left)) > enough:
                return


_FOUND = "query_id long, vec_id long, score long, evaluated long"


def _grouped(rows: DataFrame, queries: DataFrame, t: Table, k: int, chunks: int) -> DataFrame:
    """``rows(id, v, d, cell, block)`` and ``queries(id, v, d, floor, cell, block)`` through the kernel."""
    key = ["cell", "block", "chunk"]
    left = rows.select("id", "v", "d", F.lit(None).cast("double").alias("floor"), F.lit(0).alias("role"), "cell", "block",
                       F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = queries.select("id", "v", "d", "floor", F.lit(1).alias("role"), "cell", "block",
                           F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))
    return left.unionByName(right).groupBy(*key).applyInArrow(_search(t, k), _FOUND)


def _valid(vectors: DataFrame, id_col: str, vector_col: str, scale: int, query: Column) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != F.lit(float("inf"))))
    # floor of a double as a double: beyond 2^52 a double is whole
    whole = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return vectors.where(v.isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))


def search(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: int = SCALE, pivots: int = PIVOTS, block: int | None = None, chunk: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score, n_evaluated``: the k rows of greatest integer inner product of every query row.

    ``query`` says which rows are queries; ``n_evaluated`` is the number of rows whose score a query computed
    after the elimination, of all its candidates.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, n_evaluated long")
    rows = save(_valid(vectors, id_col, vector_col, scale, query), "pivot-vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("top")).first()
    asks = rows.where(F.col("asks") & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    if not whole["n"]:
        return empty
    # 1: pivots, cells, blocks
    slots = spark.sparkContext.defaultParallelism
    block = block or min(max(whole["n"] // (4 * slots), BLOCK[0]), BLOCK[1])
    dim = max(int(whole["dim"]), 1)
    sample = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(SAMPLE).collect()
    points = np.zeros((len(sample), dim))
    for at, r in enumerate(sample):
        points[at, : len(r["v"])] = r["v"]
    t = Table(np.empty((0, dim)), dim, float(whole["top"]))
    t.pivots = farthest_first(t._more(points), pivots)
    t.cells = max(1, min(len(t.pivots), whole["n"] // block))
    fine = save(rows.select("id", "v").mapInArrow(_prepare(t), "id long, v array<double>, d array<smallint>, cell int")
                .withColumn("row", F.monotonically_increasing_id()), "pivot-table")
    ranges = fine.select("d", "cell").mapInArrow(_ranges, "cell int, pivot int, low int, high int").groupBy(
        "cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    low = np.full((t.cells, len(t.pivots)), STEPS, np.int32)  # no cell of rows: no block either
    high = np.zeros((t.cells, len(t.pivots)), np.int32)
    for r in ranges:  # at most PIVOTS ^ 2
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    size = {r["cell"]: -(-r["count"] // block) for r in fine.groupBy("cell").count().collect()}
    blocks = F.array(*[F.lit(size.get(c, 0)) for c in range(t.cells)])
    dealt = fine.withColumn("block", F.pmod(F.xxhash64("row"), F.element_at(blocks, F.col("cell") + 1)).cast("int"))
    # 2: floors
    asks = save(asks.mapInArrow(_cell_bounds(t, low, high), "id long, v array<double>, d array<smallint>, most array<double>"),
                "pivot-queries")
    n_asks = asks.count()
    if not n_asks:
        return empty
    chunks = -(-n_asks // (chunk or min(max(n_asks // slots, QUERIES[0]), QUERIES[1])))
    home = F.array_position("most", F.array_max(F.filter("most", lambda x, c: F.element_at(blocks, c + 1) > 0))) - 1
    one = asks.select("id", "v", "d", F.lit(float("-inf")).alias("floor"), home.cast("int").alias("cell")).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("cell") + 1)).cast("int"))
    near = save(_grouped(dealt, one, t, k, chunks), "pivot-floors")
    floors = near.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    # 3: every cell that the floor leaves
    asks = asks.join(floors, F.col("id") == F.col("query_id"), "left").withColumn(
        "floor", F.coalesce("floor", F.lit(float("-inf"))))
    left = asks.select("id", "v", "d", "floor", F.posexplode("most").alias("cell", "reaches")).where(
        "reaches >= floor").withColumn("n", F.element_at(blocks, F.col("cell") + 1)).where("n > 0")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = _grouped(dealt, left, t, k, chunks)
    # 4: merge
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn(
        "n_evaluated", F.sum("evaluated").over(Window.partitionBy("query_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_evaluated")
