"""A table that finds rows by key without reading itself whole (J7a, J7b, J7d, J7f for small batches).

Rows lie in *generations*.  An append writes one, dealt by the leading bits of its keys' hash into ``2^bits`` bucket
folders of one file each, with ``bits`` from its number of rows, so a file has about ``rows_per_file`` rows at any size.
For a batch of k keys ``near`` opens, of each generation, only the at most k files that can hold them.  Once ``fanout``
generations are of about one size they are merged into one, so there are at most ``fanout`` times the logarithm (to
base ``fanout``) of the number of rows of them, and a row is rewritten once for each step of that logarithm.

A generation counts once a version of the list of live generations names it: a version is one small file, written
after the rows.  Whatever an append that was cut off left behind is never read, and the next append replaces it.
One writer at a time, as in a stream; readers may go on while it writes.

Keys may repeat and may be null (a null key is equal to none, as in the joins).  An empty append writes nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from imprint.operators.tables import first_by_key, new_rows, numbered

MAX_BITS = 20  # a million files a generation
BUCKET = "bucket"
ROWS_PER_TASK = 250_000  # of an append, where its files are smaller
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LISTING_TASKS = 64  # that look up the files of many folders


@dataclass(frozen=True)
class Generation:
    gen: int
    bits: int
    rows: int
    max_id: int | None
    missing: frozenset[int]  # buckets that no key fell into


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str],
                 id_col: str | None = "id", rows_per_file: int = 1_000_000, fanout: int = 8):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.id_col, self.rows_per_file, self.fanout = id_col, rows_per_file, fanout
        self._known: tuple[int, list[Generation]] = (0, [])

    # -- the list of live generations

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jpath

    def _version(self) -> int:
        """The newest version (0: none)."""
        fs, glob = self._fs(f"{self.path}/live/v=*.json")
        return max((int(s.getPath().getName()[2:-5]) for s in fs.globStatus(glob) or []), default=0)

    def generations(self) -> list[Generation]:
        version = self._version()
        if version != self._known[0]:
            fs, file = self._fs(f"{self.path}/live/v={version}.json")
            stream = fs.open(file)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._known = (version, [Generation(g["gen"], g["bits"], g["rows"], g["max_id"], frozenset(g["missing"]))
                                     for g in json.loads(text)])
        return self._known[1]

    def _commit(self, live: list[Generation]) -> None:
        """Write the next version beside its place and move it there."""
        version = self._known[0] + 1
        text = json.dumps([{**vars(g), "missing": sorted(g.missing)} for g in live])
        fs, draft = self._fs(f"{self.path}/live/.draft-{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(draft, self._fs(f"{self.path}/live/v={version}.json")[1]):
            raise RuntimeError(f"{self.path} has another writer: version {version} is there already")
        self._known = (version, live)

    def max_id(self) -> int:
        """The largest id (0: none), from the list alone."""
        return max((g.max_id or 0 for g in self.generations()), default=0)

    def count(self) -> int:
        return sum(g.rows for g in self.generations())

    # -- reading

    def read(self) -> DataFrame:
        return self._open([self._folder(g.gen) for g in self.generations()])

    def near(self, incoming: DataFrame) -> DataFrame:
        """The rows that can hold a key of ``incoming``: all that do, and whatever lies in the same files."""
        return self._open(self.folders(incoming))

    def folders(self, incoming: DataFrame) -> list[str]:
        """The bucket folders, of one file each, that ``near`` reads.

        The driver gets the distinct leading bits of the batch's keys, at most one number per file of the widest
        generation, and nothing at all while every generation is a single file.
        """
        live = self.generations()
        most = max((g.bits for g in live), default=0)
        tops = [0]
        if most:
            tops = [r[0] for r in incoming.select(self._bucket(most).alias(BUCKET)).distinct().collect()]
        out = []
        for g in live:
            at = {t >> (most - g.bits) for t in tops} - g.missing
            whole = len(at) + len(g.missing) == 1 << g.bits
            out += [self._folder(g.gen)] if whole and g.bits else [self._folder(g.gen, b) for b in sorted(at)]
        return out

    def _open(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # the default is a task a folder, each of which sends the driver more about itself than about its file
        was = self.spark.conf.get(LISTING, None)
        self.spark.conf.set(LISTING, str(LISTING_TASKS))
        try:
            rows = self.spark.read.option("basePath", f"{self.path}/rows").schema(self.schema).parquet(*folders)
        finally:
            self.spark.conf.unset(LISTING) if was is None else self.spark.conf.set(LISTING, was)
        return rows.select(*self.schema.names)

    def _folder(self, gen: int, bucket: int | None = None) -> str:
        return f"{self.path}/rows/gen={gen}" + ("" if bucket is None else f"/{BUCKET}={bucket}")

    def _bucket(self, bits: int) -> Column:
        if not bits:
            return F.lit(0)
        key = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits).cast("int")

    # -- writing

    def append(self, df: DataFrame, size: tuple[int, int | None] | None = None) -> int:
        """Write ``df`` as a generation, then merge what has become alike in size; returns its number of rows.

        ``size`` is its number of rows and its largest id, where the caller knows them; else ``df`` is evaluated
        once more.  Pass rows that are stored or checkpointed: up to ``rows_per_file`` are written by one task.
        """
        live = self.generations()
        made = self._write(df, live, size)
        if made is None:
            return 0
        self._commit([*live, made])
        while (alike := self._alike()):
            live = self.generations()
            rows = self._open([self._folder(g.gen) for g in alike])
            ids = [g.max_id for g in alike if g.max_id is not None]
            made_of = self._write(rows, live, (sum(g.rows for g in alike), max(ids, default=None)))
            self._commit([*[g for g in live if g not in alike], made_of])
        return made.rows

    def insert(self, rows: DataFrame, keys: list[str], order: list[str]) -> int:
        """Append the rows whose ``keys`` (the table's among them) it doesn't hold yet, one row a key, with ids
        that go on from the largest one in the order of ``order``; returns how many."""
        base = self.max_id()
        fresh = new_rows(first_by_key(rows, keys, [c for c in order if c not in keys]), self.near(rows), keys)
        new, n = numbered(fresh, order, base, self.id_col)
        return self.append(new, (n, base + n)) if n else 0

    def _alike(self) -> list[Generation]:
        tiers: dict[int, list[Generation]] = {}
        for g in self.generations():
            tiers.setdefault(int(math.log(g.rows, self.fanout) + 1e-9), []).append(g)
        return next((t for _, t in sorted(tiers.items()) if len(t) >= self.fanout), [])

    def _write(self, df: DataFrame, live: list[Generation], size: tuple[int, int | None] | None) -> Generation | None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        if size is None:
            top = F.max(self.id_col) if self.id_col else F.lit(None)
            size = tuple(df.agg(F.count(F.lit(1)), top.cast("long")).first())
        rows, max_id = size
        if not rows:
            return None
        bits = min(MAX_BITS, max(0, math.ceil(math.log2(rows / self.rows_per_file))))
        gen = max((g.gen for g in live), default=0) + 1
        # static: whatever a writer that was cut off left in this folder goes
        dealt = df.withColumn(BUCKET, self._bucket(bits))
        # a bucket is one task's; where buckets are small a task writes many, one after the other
        slots = max(self.spark.sparkContext.defaultParallelism, 1)
        tasks = min(1 << bits, max(slots * 4, math.ceil(rows / ROWS_PER_TASK)))
        dealt = dealt.repartition(tasks, BUCKET) if bits else dealt.coalesce(1)
        (dealt.sortWithinPartitions(BUCKET, *self.keys).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(self._folder(gen)))
        fs, folder = self._fs(self._folder(gen))
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        there = {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}
        return Generation(gen, bits, rows, max_id, frozenset(range(1 << bits)) - there)

    def vacuum(self) -> int:
        """Delete generations that merges have replaced and all versions but the newest; returns how many generations.

        For times without readers of an earlier version.
        """
        keep, newest = {g.gen for g in self.generations()}, self._known[0]
        gone = 0
        for sub, stays in (("rows", lambda n: n in keep), ("live", lambda n: n >= newest)):
            fs, folder = self._fs(f"{self.path}/{sub}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                name = s.getPath().getName().removesuffix(".json")
                if "=" in name and not stays(int(name.split("=")[1])):
                    fs.delete(s.getPath(), True)
                    gone += sub == "rows"
        return gone
