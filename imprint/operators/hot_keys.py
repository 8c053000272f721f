"""An equi-join of two sides whose hot keys are cut into block pairs, so no task gets all rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.session import materialise

HOT = 4096  # rows of one key in one block


def cut_hot(left: DataFrame, right: DataFrame, key: list[str], hot: int = HOT, by: str = "id") -> tuple:
    """``(left, right, columns to join on)``: the join has the rows of the one on ``key``, each once.

    A key with c > ``hot`` rows of ``right`` gets ceil(c / hot) blocks.  Rows of either side are hashed on ``by`` into
    one block of their own and stand once for every block of the other side.  Without such a key nothing changes.
    """
    shared = materialise(right.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(
        *key, F.ceil(F.col("c") / F.lit(float(hot))).cast("int").alias("_blocks")), "hot-keys")
    if not shared.limit(1).count():
        return left, right, key
    mine = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))

    def cut(side: DataFrame, here: str, there: str) -> DataFrame:
        side = side.join(shared, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        return side.withColumn(here, mine).withColumn(there, every).drop("_blocks")

    return cut(left, "_l", "_r"), cut(right, "_r", "_l"), [*key, "_l", "_r"]
