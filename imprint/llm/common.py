"""Helpers shared by the operators of this subpackage.

Nothing here is driver-bound: intermediate tables go to the folder named by
``spark.checkpoint.dir`` (see ``imprint.session``), and the connected-components
job is a sequence of joins over edge tables.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.session import materialise

TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return materialise(df, name)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of ``frames`` has it (whatever the case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


class HashOf(dict):
    """Bounded memo: bytes -> 64-bit hash; emptied when full, long words not kept, so its bytes are bounded."""

    def __init__(self, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.limit, self.longest = limit, longest
        MEMOS.append(self)

    def hash(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


MEMOS: list[dict] = []  # of this worker


def forget() -> None:
    """Empty every memo of this worker."""
    for memo in MEMOS:
        memo.clear()


def freeing(run):
    """``run`` over the batches of a task; memos are emptied at its end, so that no worker carries them on."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            forget()
    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)``: every vertex with its smallest reachable one.

    Alternating large-star / small-star rounds; each is a partial aggregate and
    an equi-join whose large side AQE may split, written to the shared folder.
    A hot vertex costs one aggregated row per task.  Returns ``(id, component)``
    for the vertices that have an edge.
    """
    now = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        # settled: every u hangs on one v, and no v hangs on another
        ends = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("at")).unionByName(
            now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("at")))
        per = ends.groupBy("u").agg(F.sum("out").alias("o"), F.max("at").alias("a"))
        if not per.where("o > 1 or (o = 1 and a = 1)").limit(1).count():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = save(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    heads = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(heads)


MAP_BITS = 1 << 22


def mark(df: DataFrame, marked: DataFrame, keys: list[str], flag: str = "_marked") -> DataFrame:
    """``df`` with a boolean ``flag``: true for every row whose ``keys`` occur in ``marked`` (and for a few more).

    A bitmap of ``MAP_BITS`` bits, at most ``MAP_BITS / 64`` rows of two longs, is broadcast whatever the
    size of ``marked``.  It has no misses, so what isn't marked needs no join; the caller joins the rest.
    """
    bit, word, bits = (fresh(c, df) for c in ("_bit", "_word", "_bits"))
    at = F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))
    words = marked.select(at.alias(bit)).groupBy(F.expr(f"{bit} div 64").alias(word)).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({bit} % 64 as int))")).alias(bits))
    return (df.withColumn(bit, at).withColumn(word, F.expr(f"{bit} div 64"))
            .join(F.broadcast(words), word, "left")
            .withColumn(flag, F.expr(f"coalesce(shiftrightunsigned({bits}, cast({bit} % 64 as int)) & 1, 0) = 1"))
            .drop(bit, word, bits))


def slices(batch, column: int, limit: int = 1 << 20):
    """Parts of an Arrow batch with about ``limit`` bytes of string ``column`` each, before any is made Python objects."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(size // limit)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
