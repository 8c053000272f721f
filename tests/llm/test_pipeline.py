"""The pipeline against its stages' brute-force versions on the smallest driver tables."""

from __future__ import annotations

from imprint.llm import minhash, quality, spans
from imprint.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, _, _, _, three, cover, longest = quality.facts(list(docs.values()))
    good = [i for k, i in enumerate(docs) if n[k] >= 50 and 2 * three[k] <= n[k] and cover[k] <= 0.3 * n[k] and longest[k] <= 100]
    sets = {i: set(minhash.shingle_set(docs[i]).tolist()) for i in good}
    root = {i: i for i in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in good:
        for b in good:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    seen, left = set(), {}
    for i in sorted(i for i in good if find(i) == i):
        hashes = spans.span_hashes(*spans.sentences(spans._tokens(docs[i])))[2].tolist()
        text, gone = spans.drop_copies(docs[i], {h for h in hashes if h in seen})
        seen.update(hashes)
        if text or not gone:
            left[i] = text
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == columns
    assert {r.doc_id: r.text for r in frame.collect()} == left
    assert all(r.n_chars == len(r.text) for r in frame.collect())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == set(left)


def test_passage_stage_leaves_no_repeated_window(spark):
    """Planted passages of 51 to 80 words, cut loose from their sentences, by word windows without operator code."""
    import random

    import corpus_pipeline

    r = random.Random(3)
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    hosts = [x for x in frame.orderBy("doc_id").collect() if x.text and len(x.text.split()) >= 150][:60]
    planted, rows = [], []
    for k, x in enumerate(hosts):
        ends = r.choice([[""], ["", "", "", "", ".", ","]])
        planted.append([f"p{k}x{j}{r.choice(ends)}" for j in range(r.randint(51, 80))] if k % 2 == 0 else planted[-1])
        words = x.text.split()
        cut = r.randint(20, len(words) - 20)
        rows.append({**x.asDict(), "doc_id": k, "text": " ".join(words[:cut] + planted[-1] + words[cut:])})
    out = corpus_pipeline.passage_dedup(spark, spark.createDataFrame(rows, frame.schema), SF)
    left = {x.doc_id: x.text.split() for x in out.collect()}
    seen = set()
    for k in sorted(left):
        windows = {tuple(left[k][j : j + 50]) for j in range(len(left[k]) - 49)}
        assert not windows & seen, k
        seen |= windows
    for k, p in enumerate(planted):
        own = [w for w in left.get(k, []) if w in set(p)]
        assert own == (p if k % 2 == 0 else []), k


def test_stages_take_empty_tables(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
