"""Image sources (S1, S2, S3) and a tiny PNG writer used to derive raster files from grids.

* Batch: ``spark.read.format("image")`` with ``recursiveFileLookup`` decodes every
  file under the root on the executors; undecodable files come back with
  ``height = -1`` and are routed to a quarantine output instead of failing later.
  Differences from a plain directory walk: Spark skips names starting with
  ``.`` or ``_`` (files and folders).
* Stream: the same source with ``maxFilesPerTrigger`` gives bounded batches of
  new files, remembered by the checkpoint (the "not ingested before" set).  The
  stream has a session of its own, in which the files of a batch are looked up
  by a bounded number of tasks; Spark's default is a task a file.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.sources.keyed import LISTING, LISTING_TASKS
from imprint.sources.paths import decode_origin, user_from_path

IMAGE_SCHEMA = (
    "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
)


def _check_root(spark: SparkSession, root: str) -> None:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(root)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        raise ValueError(f"Input path {root} does not exist")


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """S1 + S3 + P1: (path, user_name, image) for every decodable or undecodable file under ``root``."""
    _check_root(spark, root)
    df = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    path = decode_origin(F.col("image.origin"))
    return df.select(path.alias("path"), user_from_path(path, root).alias("user_name"), "image")


def split_valid(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decodable, quarantined) by ``image.height``."""
    ok = F.col("image.height") > 0
    return images.where(ok), images.where(~ok)


def _stream_session(spark: SparkSession) -> SparkSession:
    """A new session with the settings of ``spark``, but ``LISTING_TASKS`` (a stream needs it as long as it runs)."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if own.conf.get(k, None) != v:  # set in this session, so it can be set in the other
            own.conf.set(k, v)
    own.conf.set(LISTING, str(LISTING_TASKS))
    return own


def stream_images(spark: SparkSession, root: str, max_files: int = 10) -> DataFrame:
    """Incremental, bounded ingest of new files under ``root`` (checkpointed by the sink)."""
    _check_root(spark, root)
    df = (_stream_session(spark).readStream.format("image").schema(IMAGE_SCHEMA)
          .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(root))
    path = decode_origin(F.col("image.origin"))
    return df.select(path.alias("path"), user_from_path(path, root).alias("user_name"), "image")


def png_bytes(pixels, width: int, height: int, channels: int) -> bytes:
    """Minimal 8-bit PNG (grey, RGB or RGBA) from row-major bytes, filter 0 on every row."""
    color = {1: 0, 3: 2, 4: 6}[channels]
    raw = bytes(pixels)
    stride = width * channels
    body = b"".join(b"\x00" + raw[r * stride:(r + 1) * stride] for r in range(height))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
