"""The ``hashes`` table laid out for keyset scans: by method, sorted by id, with an index of its files.

Files hold about ``rows_per_file`` consecutive ids of one method, so a page ``WHERE method = m AND id >= start
ORDER BY id LIMIT n`` is in one file, or two where it crosses a file's end.  The index (one row a file: method,
least and greatest id, rows) says which; the others are never opened, however many there are.  Within a file the
rows are sorted, so Parquet's column index prunes its pages.

A page gives a token, the id that the next one starts at, and a walk is resumed from any token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METHOD, ID = "hashing_method_id", "id"


@dataclass
class Page:
    rows: DataFrame
    next_start: int | None  # None: this was the last page
    files: list[str]  # what it opened


def write_ordered(hashes: DataFrame, path: str, rows_per_file: int = 1_000_000) -> "OrderedHashes":
    """Write ``hashes`` (any columns besides method and id) and its index under ``path``."""
    spark = hashes.sparkSession
    n = hashes.count()
    keys = [METHOD, ID]
    (hashes.repartitionByRange(max(1, -(-n // rows_per_file)), *keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").partitionBy(METHOD).parquet(f"{path}/data"))
    written = spark.read.schema(hashes.schema).parquet(f"{path}/data")
    written.groupBy(METHOD, F.col("_metadata.file_path").alias("file")).agg(
        F.min(ID).alias("min_id"), F.max(ID).alias("max_id"), F.count(F.lit(1)).alias("rows")
    ).write.mode("overwrite").parquet(f"{path}/index")
    return OrderedHashes(spark, path)


class OrderedHashes:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = spark.read.parquet(f"{path}/index")
        self.schema = spark.read.parquet(f"{path}/data").schema

    def scan(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data")

    def methods(self) -> list[int]:
        """The methods that have hashes, from the index alone."""
        return [r[METHOD] for r in self.index.select(METHOD).distinct().orderBy(METHOD).collect()]

    def page(self, method: int, start: int, size: int) -> Page:
        """The first ``size`` hashes of a method with ``id >= start``, in id order."""
        later = self.index.where((F.col(METHOD) == method) & (F.col("max_id") >= start)).orderBy("min_id")
        files, have = [], 0
        for f in later.select("file", "min_id", "rows").limit(size + 1).collect():  # a file has a row at least
            if have >= size:
                break
            files.append(f["file"])
            # of the first file only a part may be left
            have += f["rows"] if f["min_id"] >= start else self._rows(files, method, start).limit(size).count()
        if not files:
            return Page(self.scan().limit(0), None, [])
        rows = self._rows(files, method, start).orderBy(ID).limit(size)
        last = rows.agg(F.max(ID).alias("last"), F.count(F.lit(1)).alias("n")).first()
        return Page(rows, last["last"] + 1 if last["n"] == size else None, files)

    def _rows(self, files: list[str], method: int, start: int) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(self.schema).parquet(*files)
        return rows.where((F.col(METHOD) == method) & (F.col(ID) >= start))

    def walk(self, method: int, size: int, start: int = 0):
        """All pages of a method from a token on."""
        while start is not None:
            page = self.page(method, start, size)
            yield page
            start = page.next_start

    def pages(self, size: int) -> DataFrame:
        """The whole walk in one job: every hash with the number of its page (from 0) within its method.

        A row's place is the rows of the files before its own (a window over the index, one row a file) and its
        place in its file; nothing is sorted or shuffled.
        """
        before = self.index.select("file", (F.sum("rows").over(
            Window.partitionBy(METHOD).orderBy("min_id")) - F.col("rows")).alias("before"))
        rows = self.scan().select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return rows.join(before, "file").withColumn("page", F.expr(f"cast((before + at) div {size} as int)")).drop(
            "file", "at", "before")
