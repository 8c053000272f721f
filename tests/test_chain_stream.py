"""End-to-end: the stored chain is idempotent and incremental; the stream is replay safe."""

import os
import tempfile

import numpy as np

from imprint.plans import chain as C
from imprint.session import scratch_path
from imprint.sources.images import png_bytes
from imprint.sources.store import Store
from imprint.streaming.ingest import ingest_documents
from tests.conftest import SF001


def _png(folder, rel, arr):
    p = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(png_bytes(arr.tobytes(), arr.shape[1], arr.shape[0], 1))


def test_chain_rerun_and_incremental_match(spark):
    src = tempfile.mkdtemp(prefix="imprint-src-")
    rng = np.random.default_rng(3)
    for i in range(6):
        _png(src, f"user{i % 2}/{i}.png", rng.integers(0, 256, (24, 24), dtype=np.uint8))
    _png(src, "user0/copy.png", np.full((8, 8), 5, dtype=np.uint8))
    _png(src, "user1/copy2.png", np.full((8, 8), 5, dtype=np.uint8))  # same content, second writer
    store = Store(spark, scratch_path(spark, "store"))
    r1 = C.ingest_folder(spark, store, src, "/variants")
    # 8 images; 6 random x 2 variants + 1 uniform (rotation and the copy are the same content)
    assert (r1.images, r1.modified_images, r1.hashes) == (8, 13, 26)
    assert store.read("users").count() == 3  # undefined + user0 + user1
    r2 = C.ingest_folder(spark, store, src, "/variants")
    assert (r2.images, r2.modified_images, r2.hashes) == (0, 0, 0)
    n1 = C.match_new(spark, store)
    assert n1 == 2 * (13 * 14 // 2)
    assert C.match_new(spark, store) == 0
    # new files arrive: only their pairs are added, total is the full triangle
    for i in range(6, 9):
        _png(src, f"user2/{i}.png", rng.integers(0, 256, (24, 24), dtype=np.uint8))
    r3 = C.ingest_folder(spark, store, src, "/variants")
    assert r3.images == 3 and r3.hashes == 12
    C.match_new(spark, store)
    m = store.read("matches")
    assert m.count() == 2 * (19 * 20 // 2)
    assert m.groupBy("hash_id1", "hash_id2").count().where("count > 1").count() == 0
    ids = [r["id"] for r in store.read("hashes").orderBy("id").collect()]
    assert ids == list(range(1, 39))


def test_document_stream_is_replay_safe(spark):
    sink = scratch_path(spark, "sink")
    out = ingest_documents(spark, SF001, sink=sink, checkpoint=scratch_path(spark, "ck"))
    assert out.count() == 189
    again = ingest_documents(spark, SF001, sink=sink, checkpoint=scratch_path(spark, "ck2"))
    assert again.count() == 189


def test_image_stream_matches_batch_and_replays_safely(spark):
    src = tempfile.mkdtemp(prefix="imprint-stream-src-")
    rng = np.random.default_rng(21)
    for i in range(5):
        _png(src, f"s{i % 2}/{i}.png", rng.integers(0, 256, (16, 16), dtype=np.uint8))
    store = Store(spark, scratch_path(spark, "stream-store"))
    q = C.ingest_stream(spark, store, src, "/variants", scratch_path(spark, "img-ck"), max_files=2)
    q.awaitTermination()
    assert q.exception() is None
    assert store.read("images").count() == 5
    assert store.read("modified_images").count() == 10
    assert store.read("hashes").count() == 20
    # bounded batches: 5 files at 2 per trigger
    assert len(q.recentProgress) >= 3
    # replay everything with a fresh checkpoint: nothing new is inserted
    q2 = C.ingest_stream(spark, store, src, "/variants", scratch_path(spark, "img-ck2"), max_files=2)
    q2.awaitTermination()
    assert store.read("hashes").count() == 20
    assert C.match_new(spark, store) == 2 * (10 * 11 // 2)


def test_chain_completes_an_interrupted_batch(spark):
    """Images stored, then a crash before variants: the next run must still modify and hash them."""
    from pyspark.sql import functions as F

    from imprint.operators.registry import HASHING_METHODS, MODIFICATIONS
    from imprint.sources.images import read_images

    src = tempfile.mkdtemp(prefix="imprint-crash-")
    rng = np.random.default_rng(17)
    for i in range(4):
        _png(src, f"c/{i}.png", rng.integers(0, 256, (10, 10), dtype=np.uint8))
    store = Store(spark, scratch_path(spark, "crash-store"))
    store.init(MODIFICATIONS.names(), HASHING_METHODS.names())
    # the load stage ran (users + images) and then the job died
    store.ensure_names("users", ["c"])
    paths = read_images(spark, src).select("path").orderBy("path").collect()
    uid = store.read("users").where("name = 'c'").first()["id"]
    store.append("images", spark.createDataFrame(
        [(i + 1, r["path"], uid) for i, r in enumerate(paths)], "id long, path string, user_id long"))
    r = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert r.images == 0 and r.modified_images == 8 and r.hashes == 16
    assert store.read("variant_rasters").count() == 8
    again = C.ingest_folder(spark, store, src, "/v", store_rasters=True)
    assert (again.images, again.modified_images, again.hashes) == (0, 0, 0)
    assert store.read("variant_rasters").count() == 8
    assert store.read("images").agg(F.max("id")).first()[0] == 4


def test_non_image_files_are_quarantined(spark):
    src = tempfile.mkdtemp(prefix="imprint-bad-")
    rng = np.random.default_rng(2)
    _png(src, "q/ok.png", rng.integers(0, 256, (9, 9), dtype=np.uint8))
    with open(os.path.join(src, "q", "notes.txt"), "w") as fh:
        fh.write("not an image")
    store = Store(spark, scratch_path(spark, "bad-store"))
    r = C.ingest_folder(spark, store, src, "/v")
    # the load stage records every file; only the decodable one gets variants and hashes
    assert (r.images, r.modified_images, r.hashes, r.quarantined) == (2, 2, 4, 1)
    from imprint.sources.images import read_images

    bad = C.quarantine(read_images(spark, src)).collect()
    assert [os.path.basename(b["path"]) for b in bad] == ["notes.txt"]


def test_stream_looks_up_the_files_of_a_batch_with_few_tasks(spark):
    from imprint.sources.images import stream_images
    from imprint.sources.keyed import LISTING, LISTING_TASKS

    src = tempfile.mkdtemp(prefix="imprint-many-")
    for i in range(LISTING_TASKS + 20):
        _png(src, f"u{i % 3}/{i}.png", np.full((4, 4), i, dtype=np.uint8))
    was, seen = spark.conf.get(LISTING, None), []
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        stream = stream_images(spark, src, max_files=1000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    q = (stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.select("path").count()))
         .option("checkpointLocation", scratch_path(spark, "many-ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert q.exception() is None and seen == [LISTING_TASKS + 20]
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(str(q.runId)) for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= LISTING_TASKS  # a task a file before
    assert spark.conf.get(LISTING, None) == was
    assert stream.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"  # the settings go along


def test_matches_are_read_without_a_join_a_pair(spark):
    store = Store(spark, scratch_path(spark, "committed-store"))
    pairs = spark.createDataFrame([(1, 1, 0.0, 1), (1, 2, 0.5, 1), (3, 3, 0.0, 2)], store.read("matches").schema)
    assert store.write_matches(pairs, {1: 2, 2: 3}) == {1: 2, 2: 1}
    assert store.read("matches").count() == 0  # no manifest row yet
    store.commit_matches({1: 2}, {1: 2})
    rows = store.read("matches")
    assert sorted(map(tuple, rows.collect())) == [(1, 1, 0.0, 1), (1, 2, 0.5, 1)]
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    store.write_matches(spark.createDataFrame([(2, 3, 0.25, 1)], pairs.schema), {1: 3})
    assert store.read("matches").count() == 2  # the second run isn't committed
    store.commit_matches({1: 3}, {1: 1})
    assert sorted(map(tuple, store.read("matches").select("hash_id1", "hash_id2").collect())) == [(1, 1), (1, 2), (2, 3)]
