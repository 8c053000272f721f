"""Idempotent table operators: dedup, insert-or-ignore, serial ids, lookups, audits.

Every stage of the chain writes with *insert-or-ignore on a unique key* and
passes on only the rows it actually inserted.  On Spark that is:

1. ``first_by_key`` — keep the first row per key inside the batch (W1).  A
   hash aggregate of ``min(struct(order..., payload...))``: map-side partial
   aggregation collapses a hot key before the shuffle, and the survivor is
   deterministic (not ``dropDuplicates``' arbitrary one).
2. ``left_anti`` against the existing table's key columns (J7).
3. ``assign_ids`` — dense serial ids continuing after ``max(id)`` in a stated
   order (W2), without a single-partition window: rows are range-partitioned
   and sorted, materialised to the reliable checkpoint folder so partitions are
   stable, then numbered as partition offset + position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.session import cut_lineage


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the one that is first by ``order`` (ties broken by the remaining columns)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and len(order) <= 1:
        # a single ordering column and nothing else: plain min(), a hash aggregate
        if not order:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(*df.columns)
    packed = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest]) \
        .select(*df.columns)


def dropped_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows ``first_by_key`` discards (exact duplicates that lost to an earlier writer)."""
    winners = first_by_key(df.select(*keys, *order), keys, order)
    return df.join(winners, on=keys + order, how="left_anti")


def losers_with_winner(df: DataFrame, keys: list[str], order_col: str, winner_col: str) -> DataFrame:
    """B1: rows that lost the first-writer race on ``keys``, with the winner's ``order_col``.

    The winners side has one row per key; a hot key on the other side is split
    by AQE's skew-join handling.
    """
    winners = df.groupBy(*keys).agg(F.min(order_col).alias(winner_col))
    return df.join(winners, keys).where(F.col(order_col) != F.col(winner_col))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``existing`` (only the key columns of ``existing`` are read)."""
    return incoming.join(existing.select(*keys), on=keys, how="left_anti")


def max_id(df: DataFrame, id_col: str = "id") -> Column:
    """``coalesce(max(id), 0)`` as a one-row aggregate (A1/A2 next-id base)."""
    return F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")


def assign_ids(df: DataFrame, order: list[str], start: int, id_col: str = "id",
               partitions: int | None = None) -> DataFrame:
    """Dense ids ``start + 1, start + 2, ...`` following ``order`` (which must be a total order)."""
    return numbered(df, order, start, id_col, partitions)[0]


def numbered(df: DataFrame, order: list[str], start: int, id_col: str = "id",
             partitions: int | None = None) -> tuple[DataFrame, int]:
    """:func:`assign_ids` and the number of rows.

    Distributed: range partitioning + per-partition positions + the per-partition counts, of which
    the driver gets one row per partition (a proven bound).  Without ``partitions`` there are as many as
    ``spark.sql.shuffle.partitions`` says, fewer where adaptive execution finds neighbours small.
    """
    by = order if partitions is None else [partitions, *order]
    ordered = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*order))
    pos = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["_n"] for r in pos.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).collect()}
    before, total = [0] * (max(sizes, default=-1) + 1), 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    local = F.col("_mid") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    off = F.element_at(F.lit(before or [0]).cast("array<bigint>"), F.col("_p") + 1)
    return pos.select((F.lit(start).cast("bigint") + off + local + 1).alias(id_col),
                      *[c for c in df.columns if c != id_col]), total


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None,
                     id_col: str | None = "id", base: int | None = None) -> DataFrame:
    """Rows of ``incoming`` not yet in ``existing`` on ``keys``, deduplicated, with fresh ids.

    Append the result to the table; re-running with the same input yields no rows.
    ``existing`` may be only the part of the table that can hold ``incoming``'s
    keys (e.g. its key buckets); then pass the table's largest id as ``base``.
    """
    order = order or keys
    dedup = first_by_key(incoming, keys, [c for c in order if c not in keys])
    fresh = new_rows(dedup, existing, keys)
    if id_col is None:
        return fresh
    if base is None:
        base = existing.agg(max_id(existing, id_col).alias("m")).first()["m"]
    return assign_ids(fresh, order, int(base), id_col)


def get_or_create(existing: DataFrame, requests: DataFrame, keys: list[str], id_col: str = "id",
                  order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Ids for every request row, creating missing keys.  Returns (requests with id, created rows)."""
    created = insert_or_ignore(existing, requests.select(*keys), keys, order, id_col)
    dim = existing.select(id_col, *keys).unionByName(created.select(id_col, *keys))
    return requests.join(dim, on=keys, how="left"), created


def lookup_id(df: DataFrame, dim: DataFrame, name_col: str, dim_name: str = "name", dim_id: str = "id",
              out: str = "id", strict: bool = False, broadcast_dim: bool = False) -> DataFrame:
    """Equi lookup of an id by name.  ``strict`` raises on a missing name (the reference errors).

    ``broadcast_dim`` forces a broadcast; pass it only for a dimension with a
    bound (the registries).  Otherwise Spark's size-checked planner decides.
    """
    d = dim.select(F.col(dim_name).alias(name_col), F.col(dim_id).alias(out))
    joined = df.join(F.broadcast(d) if broadcast_dim else d, on=name_col, how="left")
    if strict:
        joined = joined.withColumn(out, F.when(F.col(out).isNotNull(), F.col(out)).otherwise(
            F.raise_error(F.concat(F.lit("no id for name "), F.col(name_col)))))
    return joined


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent row."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), on=fk, how="left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """A4: keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def keyset_page(df: DataFrame, start: int, size: int, id_col: str = "id", where: Column | None = None) -> DataFrame:
    """``WHERE id >= start [AND where] ORDER BY id LIMIT size`` (TakeOrderedAndProject)."""
    q = df.where(F.col(id_col) >= F.lit(start))
    if where is not None:
        q = q.where(where)
    return q.orderBy(id_col).limit(size)


def point_lookup(df: DataFrame, select: list[str], **equals) -> DataFrame:
    """``SELECT select WHERE k1 = v1 AND ...`` (pushed to the Parquet scan)."""
    cond = None
    for k, v in equals.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df.where(cond).select(*select)


def strict_single(df: DataFrame, what: str) -> DataFrame:
    """The reference raises when a point lookup finds nothing; keep that as an opt-in check."""
    if df.limit(1).count() == 0:
        raise LookupError(f"no row for {what}")
    return df


def distinct_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The distinct method ids present (the keyset walk over methods, as one scan)."""
    return df.select(id_col).distinct()
