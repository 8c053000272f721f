"""Progress and outcome of runs as a table (T4, A3): one row per state change, written by the run itself.

A run's row says which stage it is, for streams which micro-batch, its state (``running``, ``done``,
``failed``), how many rows it newly inserted and, if it failed, the error.  The rows are data like any other
table of the store, so a run's outcome survives the driver, and a run that was cut off stays ``running``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "run_id string, stage string, batch long, state string, counted long, error string, at timestamp"


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, run_id: str, stage: str, batch: int | None, state: str, counted: int | None, error: str | None) -> None:
        row = self.spark.createDataFrame([(run_id, stage, batch, state, counted, error)], SCHEMA.rsplit(",", 1)[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def run(self, stage: str, batch: int | None = None):
        """``with log.run("match") as done: done(n)``: logs the start, then the outcome with ``n`` rows inserted."""
        run_id, counted = uuid.uuid4().hex, [0]
        self._write(run_id, stage, batch, "running", None, None)
        try:
            yield lambda n: counted.__setitem__(0, int(n))
        except Exception as e:
            self._write(run_id, stage, batch, "failed", None, _reason(e))
            raise
        self._write(run_id, stage, batch, "done", counted[0], None)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def status(self) -> DataFrame:
        """The last state of every run."""
        last = Window.partitionBy("run_id").orderBy(F.desc("at"), F.col("state") == "running")
        return self.rows().withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def counted(self, stage: str) -> int:
        """Rows that all runs of a stage have inserted; never reset."""
        return int(self.rows().where((F.col("stage") == stage) & (F.col("state") == "done")).agg(
            F.coalesce(F.sum("counted"), F.lit(0)).alias("n")).first()["n"])


def _reason(e: Exception) -> str:
    """The message that a user raised, without Spark's error class and stack."""
    lines = [x for x in str(e).splitlines() if x.strip()]
    first = lines[0] if lines else type(e).__name__
    return first.split("] ", 1)[-1].split(" SQLSTATE", 1)[0][:500]
