"""Spark session and shared-folder helpers.

Intermediate tables and checkpoints live under the folder the cluster names in
``spark.checkpoint.dir``.  We only invent a folder when the setting is absent
and Spark runs in local mode (tests, the bench); on a cluster an absent setting
is an error, because a machine-local temp folder is not visible to executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(cpus: int | str = "*", app: str = "imprint", extra: dict | None = None) -> SparkSession:
    """A session tuned for the engine's jobs (used by tests and the bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``imprint`` importable in the Python workers (Arrow UDFs, mapInPandas).

    Zips the package once per SparkContext and adds it with ``addPyFile``, the
    standard way to distribute job code; clusters that install the package on
    every executor do not need it, and a second call is a no-op.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="imprint-code-"), "imprint.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """Root of the shared folder for checkpoints and written tables.

    Reads ``spark.checkpoint.dir`` from the session.  Only when it is unset and
    the master is local do we set a fresh temp folder (tests, bench).
    """
    sc = spark.sparkContext
    root = _LOCAL_ROOTS.get(sc.applicationId) or _conf(spark)
    if not root:
        if not _is_local(spark):
            raise RuntimeError(
                f"{_CKPT_KEY} is not set; point it at a folder all executors share"
            )
        root = tempfile.mkdtemp(prefix="imprint-ckpt-")
        _LOCAL_ROOTS[sc.applicationId] = root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


_LOCAL_ROOTS: dict[str, str] = {}


def _conf(spark: SparkSession):
    try:
        v = spark.conf.get(_CKPT_KEY, None)
    except Exception:  # noqa: BLE001 - some sessions refuse to read core keys
        v = None
    return v or spark.sparkContext.getConf().get(_CKPT_KEY, None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared root for one job's output."""
    root = shared_root(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path


def cut_lineage(df):
    """Materialise ``df`` to the reliable checkpoint folder (survives executor loss)."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, factor: int = 1):
    """Give a small input at least one partition per slot before per-row heavy work.

    Large inputs already have many partitions and are returned unchanged (no shuffle).
    """
    try:
        slots = max(df.sparkSession.sparkContext.defaultParallelism, 1) * factor
        parts = df.rdd.getNumPartitions()
    except (AttributeError, NotImplementedError):  # sessions without RDD access: keep the input as it is
        return df
    return df.repartition(slots) if parts < slots else df


def materialise(df, name: str, observation=None, *metrics):
    """Write ``df`` as a Parquet table in a fresh folder of the shared root and read it back.

    Cuts lineage like ``checkpoint()``, and later reads get column pruning,
    filter pushdown and real size statistics for join planning.  Optional
    ``metrics`` are collected into ``observation`` by the same write job.
    """
    path = scratch_path(df.sparkSession, name)
    if observation is not None:
        df = df.observe(observation, *metrics)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
