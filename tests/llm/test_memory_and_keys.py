"""Row identity beyond 32-bit hashes, bounded memos, and batches of long texts."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from imprint.llm import common, quality, radixdup, words


def _cuts(spark, rows):
    got = radixdup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted(tuple(r) for r in got.select(F.coalesce("doc_id", F.lit(-9)), "n_bytes", "n_removed", "n_spans",
                                                "kept_sha256").collect())


def test_rows_whose_short_hashes_agree_stay_apart(spark):
    """Unlike texts under one id (or none) whose 32-bit hashes are equal, null ids, id -1 and repeated rows."""
    text = F.concat(F.repeat(F.lit("ab c"), 55), F.sha2(F.col("id").cast("string"), 256))
    many = spark.range(250_000).select(text.alias("text")).withColumn("h", F.hash("text"))
    pair = many.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    r = random.Random(3)
    tail = "".join(r.choices("xyz ", k=300))
    texts = [pair[0], pair[1], pair[1] + tail, tail]
    for ids in ((None, None, None, None), (7, 7, 7, 7), (None, -1, None, -1)):
        rows = [*zip(ids, texts), (ids[0], texts[0]), (ids[1], None), (None, ""), (None, None)]
        want = radixdup.brute_force([t for _, t in rows])
        assert _cuts(spark, rows) == sorted((-9 if i is None else i, *w) for (i, _), w in zip(rows, want))


def test_a_batch_of_long_texts_is_cut_before_it_is_split():
    long = [("word%d " % (i % 50)) * 400 for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(long)], names=["doc_id", "text"])
    parts = list(common.slices(batch, 1, 1 << 20))
    assert sum(p.num_rows for p in parts) == 3000 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    most = max(sum(len(t) for t in p.column(1).to_pylist()) for p in parts)
    assert most <= (1 << 20) + len(long[0])
    assert sum(b.num_rows for b in quality._rules(iter([batch]))) == 3000
    alone = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["x" * 3_000_000, None, ""])], names=["doc_id", "text"])
    assert [p.num_rows for p in common.slices(alone, 1, 1 << 20)] in ([1, 2], [3])
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string())], names=["doc_id", "text"])
    assert list(common.slices(none, 1)) == []


def test_memos_are_bounded_and_freed():
    memo = common.HashOf(limit=10, longest=5)
    values = {w: memo[w] for w in (b"%d" % i for i in range(100))}
    assert len(memo) <= 10 and memo[b"7" * 50] == common.HashOf()[b"7" * 50] and b"7" * 50 not in memo
    assert all(memo[w] == h for w, h in values.items())
    assert list(common.freeing(lambda batches: (b for b in batches))([1, 2])) == [1, 2] and not memo


@pytest.mark.parametrize("word", ["it's", "don't.", "a.b", "x,", "end!!", "$$$", "gepf***", "'ll", "12,5", "über?!", "A.", "l'été",
                                  "w'", "w'.", "w.'s", "(a)", "[x]y", "…", "a" * 90 + "."])
def test_words_encode_as_the_library_does(word):
    coder = words.WordIds(__import__("public_tokenizers").path("word_bpe_49k.json"))
    text = f"one {word} two {word}"
    assert coder.encode([text])[0].tolist() == coder.lib.encode(text, add_special_tokens=False).ids
