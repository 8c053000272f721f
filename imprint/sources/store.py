"""The seven result tables as Parquet folders under one root (S5, S6), read and appended by Spark.

Each stage appends only rows it newly inserted (insert-or-ignore, see
:mod:`imprint.operators.tables`).  The tables that a batch is compared with are laid out by key
(:mod:`imprint.sources.keyed`), so a batch opens only the files that can hold its keys.

``matches`` has a commit manifest.  A match run covers the hashes of a method above the last committed one,
``after``, up to ``upto``; its pairs go to the partition ``(hashing_method_id, after)``, which the write replaces
as a whole, and only then does one manifest row per method say that the run is complete.  The watermark is what
the manifest says, and only partitions that it names are read.  So a run that was cut off anywhere, even half way
through its files, is invisible, and the next run starts after the same hash and replaces what it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.operators.tables import insert_or_ignore
from imprint.sources.keyed import KeyedTable

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


SCHEMAS = {
    "modifications": _schema(("id", I, False), ("name", S, False)),
    "hashing_methods": _schema(("id", I, False), ("name", S, False)),
    "users": _schema(("id", L, False), ("name", S, False)),
    "images": _schema(("id", L, False), ("path", S, False), ("user_id", L, True)),
    "modified_images": _schema(("id", L, False), ("path", S, False), ("image_id", L, False),
                               ("modification_id", I, False)),
    "hashes": _schema(("id", L, False), ("hash", S, False), ("modified_image_id", L, False),
                      ("hashing_method_id", I, False)),
    "matches": _schema(("hash_id1", L, False), ("hash_id2", L, False), ("hamming_distance", D, False),
                       ("hashing_method_id", I, False)),
}
# The index of stored variant pixels; it has no part in the seven tables.
RASTERS = "variant_rasters"
RASTERS_SCHEMA = _schema(("path", S, False), ("batch", S, False), ("image_path", S, False), ("reg_id", I, False),
                         ("height", I, False), ("width", I, False), ("n_channels", I, False))
# What the keyed tables are looked up by.
KEYS = {"users": ["name"], "images": ["path"], "modified_images": ["path"], "hashes": ["modified_image_id"],
        RASTERS: ["path"]}
# The manifest: one row a method and committed run, written after the pairs.
RUNS = "match_runs"
RUNS_SCHEMA = _schema(("hashing_method_id", I, False), ("after", L, False), ("upto", L, False), ("pairs", L, False))
NONE_YET = -1  # the watermark of a method without a committed run
# Pairs are three small numbers a row, so writing them is what a match costs: pages of more rows, without the
# histograms of sizes and levels that numbers have no use for.
PAIR_PAGES = {"parquet.page.row.count.limit": "200000", "parquet.size.statistics.enabled": "false"}
# Fixed value: the seeded default user.
DEFAULT_USER = "undefined"


class Store:
    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 1_000_000):
        self.spark = spark
        self.root = root.rstrip("/")
        self._ready: tuple | None = None
        self.keyed = {name: KeyedTable(spark, self.path(name), RASTERS_SCHEMA if name == RASTERS else SCHEMAS[name],
                                       keys, None if name == RASTERS else "id", rows_per_file)
                      for name, keys in KEYS.items()}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        if name in self.keyed:
            return self.keyed[name].read()
        if not self._exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        schema = SCHEMAS[name]
        if name == "matches":
            schema = T.StructType([*schema.fields, T.StructField("after", L)])
        df = self.spark.read.schema(schema).parquet(self.path(name))
        if name == "matches":
            df = df.where(self._committed())
        return df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields])

    def _committed(self) -> Column:
        """Partitions of committed runs (the manifest has a row a method and run).

        The condition is on partition columns alone, so it prunes folders and no pair is looked at.
        """
        after: dict[int, list[int]] = {}
        for r in self.runs().select("hashing_method_id", "after").distinct().collect():
            after.setdefault(r["hashing_method_id"], []).append(r["after"])
        out = F.lit(False)
        for m, runs in after.items():
            out = out | ((F.col("hashing_method_id") == m) & F.col("after").isin(runs))
        return out

    def near(self, name: str, incoming: DataFrame) -> DataFrame:
        """The rows of a keyed table that can hold a key of ``incoming``; the other files stay closed."""
        return self.keyed[name].near(incoming)

    def insert(self, name: str, rows: DataFrame, keys: list[str], order: list[str]) -> int:
        """J7 on a keyed table: append the rows whose ``keys`` it doesn't hold yet, with fresh ids; returns how many."""
        return self.keyed[name].insert(rows, keys, order)

    def append(self, name: str, df: DataFrame) -> int:
        """Append rows (committed atomically); returns how many were written."""
        from pyspark.sql import Observation

        if name in self.keyed:
            return self.keyed[name].append(df)
        cols = [F.col(f.name).cast(f.dataType) for f in SCHEMAS[name].fields]
        obs = Observation(f"append_{name}")
        df.select(*cols).observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(self.path(name))
        return int(obs.get.get("rows", 0))

    def runs(self) -> DataFrame:
        """The manifest of committed match runs."""
        if not self._exists(RUNS):
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        return self.spark.read.schema(RUNS_SCHEMA).parquet(self.path(RUNS))

    def match_watermarks(self) -> dict[int, int]:
        """Per method, the largest hash id that a committed run has matched."""
        return {r["hashing_method_id"]: int(r["upto"]) for r in self.runs().groupBy("hashing_method_id").agg(
            F.max("upto").alias("upto")).collect()}

    def write_matches(self, pairs: DataFrame, upto: dict[int, int]) -> dict[int, int]:
        """Write a run's pairs, replacing what an uncommitted run after the same hashes left; rows per method.

        Each method's pairs (a handful of methods) go straight into the folder of their partition: a write that deals
        rows to partitions would sort all pairs of a task by them first.
        """
        from pyspark.sql import Observation

        marks = self.match_watermarks()
        cols = [F.col(f.name).cast(f.dataType) for f in SCHEMAS["matches"].fields if f.name != "hashing_method_id"]
        counts = {}
        for m in upto:
            obs = Observation(f"write_matches_{m}")
            (pairs.where(F.col("hashing_method_id") == m).select(*cols).observe(obs, F.count(F.lit(1)).alias("rows"))
             .write.mode("overwrite").option("partitionOverwriteMode", "static").options(**PAIR_PAGES)
             .parquet(f"{self.path('matches')}/hashing_method_id={m}/after={marks.get(m, NONE_YET)}"))
            counts[m] = int(obs.get.get("rows") or 0)
        return counts

    def commit_matches(self, upto: dict[int, int], counts: dict[int, int]) -> None:
        """The manifest rows of a run whose pairs are written: from here on it counts."""
        marks = self.match_watermarks()
        rows = [(m, marks.get(m, NONE_YET), u, counts.get(m, 0)) for m, u in upto.items()]
        self.spark.createDataFrame(rows, RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path(RUNS))

    def log(self):
        """Progress and outcome of the runs over this store."""
        from imprint.streaming.status import RunLog

        return RunLog(self.spark, self.path("run_log"))

    def views(self) -> None:
        """Every table as a temp view for ad-hoc ``spark.sql``."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)

    def init(self, modification_names: list[str], method_names: list[str]) -> None:
        """Create the tables, seed the default user, register dimension names (get-or-create).

        Remembered per Store and registry content, so later batches of a stream skip it.
        """
        key = (tuple(modification_names), tuple(method_names))
        if self._ready == key:
            return
        for name in SCHEMAS:
            if name in self.keyed:
                if self._exists(name) and not self._exists(f"{name}/live"):
                    raise ValueError(f"{self.path(name)} is not laid out by key: append its rows to a new store")
            elif name != "matches" and not self._exists(name):  # matches is made by its first run
                self.append(name, self.spark.createDataFrame([], SCHEMAS[name]))
        if not self.keyed["users"].count():  # S6: the seed row
            self.keyed["users"].append(self.spark.createDataFrame([(1, DEFAULT_USER)], SCHEMAS["users"]), (1, 1))
        self.ensure_names("modifications", modification_names)
        self.ensure_names("hashing_methods", method_names)
        self._ready = key

    def ensure_names(self, table: str, names: list[str]) -> None:
        """J7a/J7c/J7e on a name dimension; ids follow the given order of first appearance.

        The registry dimensions hold a handful of rows, so the present names are
        read first and the insert job runs only when one is missing.
        """
        rows = self.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")
        if table in self.keyed:
            self.insert(table, rows, ["name"], ["pos"])
            return
        stored = self.read(table)
        present = {r["name"] for r in stored.where(F.col("name").isin(names)).select("name").collect()}
        if present >= set(names):
            return
        self.append(table, insert_or_ignore(stored, rows, ["name"], ["pos"]).select("id", "name"))
