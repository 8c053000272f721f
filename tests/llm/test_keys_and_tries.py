"""Rows without id or of one id in op1, op3 and op8; several licenses a file; TF-IDF and the trie against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from imprint.llm import bpetrie, licenses, wavelet

FILES = "id long, path string, text string"


def test_rows_without_id_keep_their_license(spark):
    rows = [(None, "/a/LICENSE", "Released under the MIT License."), (None, "/a/x.c", "int x;"), (None, None, None),
            (None, "/b/y.c", "int y;"), (5, "/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
            (5, "/c/LICENSE", "Licensed under the Apache License, Version 2.0."), (5, "/c/d/z.c", "int z;"), (5, "/c/e.c", ""),
            (5, "/c/e.c", None)]
    got = Counter(tuple(r) for r in licenses.scan(spark.createDataFrame(rows, FILES).repartition(3)).select(
        "id", "path", "own_license", "license", "inherited_from").collect())
    assert got == Counter([
        (None, "/a/LICENSE", "MIT", "MIT", None), (None, "/a/x.c", None, "MIT", "/a"), (None, None, None, None, None),
        (None, "/b/y.c", None, None, None), (5, "/c/d/z.c", None, "Apache-2.0", "/c"),
        *2 * [(5, "/c/LICENSE", "Apache-2.0", "Apache-2.0", None)], *2 * [(5, "/c/e.c", None, "Apache-2.0", "/c")]])


def test_every_license_of_a_file_is_listed(spark):
    both = "Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0.\n"
    rows = [(1, "/a/x.c", "// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;"), (2, "/b/COPYING", both),
            (3, "/b/y.c", "int y;"), (4, "/c/z.c", "Copyright. All rights reserved.\n\nReleased under the MIT License."),
            (5, "/d/w.c", "Copyright. All rights reserved.")]
    got = {r.id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {1: ["Apache-2.0", "MIT"], 2: ["Apache-2.0", "MIT"], 3: ["Apache-2.0", "MIT"], 4: ["MIT"], 5: ["Proprietary"]}


def test_scores_equal_brute_force(spark):
    """Notices with words added, lost and changed: one line each, so every one is a header of three kinds."""
    r = random.Random(2)
    short = [h for _, h in licenses.TEMPLATES if len(h) < 150]
    lines = []
    for k in range(60):
        w = re.findall(r"[A-Za-z0-9]+", r.choice(short))
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(["work", "source", "thing", "under", "the", "license"])
        lines.append(" ".join([*w, "license", *r.choices(["foo", "bar", "public", "version"], k=r.randint(0, 3))]))
    terms = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    plates = [(name, Counter(terms(h))) for name, h in licenses.TEMPLATES]
    df = Counter(t for _, c in plates for t in c)
    for line in lines:
        df.update({t: 3 for t in set(terms(line))})
    total = 3 * len(lines) + len(plates)
    weight = lambda c: {t: n * (math.log((1 + total) / (1 + df[t])) + 1) for t, n in c.items()}
    size = lambda w: math.sqrt(sum(x * x for x in w.values()))
    want = {}
    for k, line in enumerate(lines):
        a, scores = weight(Counter(terms(line))), {}
        for name, c in plates:
            b = weight(c)
            s = round(sum(x * b.get(t, 0) for t, x in a.items()) / size(a) / size(b), 6)
            scores[name] = max(s, scores.get(name, 0))
        named = {n: s for n, s in scores.items() if s >= licenses.LEAST}
        top = max(named.values(), default=None)
        want[k] = (min(n for n, s in named.items() if s == top) if named else None, top)
    rows = [(k, f"/{k}/f.txt", line) for k, line in enumerate(lines)]
    got = {x.id: (x.own_license, x.own_score) for x in licenses.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs((got[k][1] or 0) - (v[1] or 0)) < 2e-6 for k, v in want.items())
    assert 10 < sum(v[0] is not None for v in want.values()) < 60


def _library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


def test_trie_equals_the_library_on_ragged_texts():
    """White space of all kinds, runs, marks, contractions, special tokens; a memo that is full again and again."""
    path, lib = _library("byte_bpe_50k.json")
    coder, r = bpetrie.TrieBPE(path, memo=50), random.Random(5)
    bits = [" ", " ", "  ", "\n", "\n\n", "\t", " \n", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "a", "the", "The",
            "ing", "é", "ß", "日本", "👍", "'s", "'S", "'re", "1", "23", "...", "!?", "--", "<|endoftext|>", "<|", "x" * 90,
            "aaaa", "\0", "Ж", "tion"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["ab " * 20_000, "y" * 3000]
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        for line, e in zip(coder.encode(part), lib.encode_batch(part, add_special_tokens=False)):
            assert line == ",".join(map(str, e.ids))
            assert coder.decode(line).decode() == lib.decode(e.ids, skip_special_tokens=False)
    assert max(map(len, coder.memo)) <= bpetrie.LONGEST


def test_pairs_stay_apart_as_plain_merging_says():
    path, _ = _library("byte_bpe_50k.json")
    coder, r = bpetrie.TrieBPE(path), random.Random(6)
    whole = [i for i in coder.id_of.values() if coder._whole(i)]
    runs = [i for i in whole if len(set(coder.bytes_of[i])) == 1]
    pairs = [(r.choice(whole), r.choice(whole)) for _ in range(5000)] + [(r.choice(runs), r.choice(runs)) for _ in range(5000)]
    assert coder.ranked
    for a, b in pairs:
        assert coder._apart(a, b) == (coder.merged(coder.bytes_of[a] + coder.bytes_of[b]) == [a, b])


def test_shared_beginnings():
    raws = sorted([b"", b"a", b"a\0", b"ab", b"x" * 32, b"x" * 40, b"x" * 40 + b"\0", b"x" * 41, b"\0", b"\0\0"])
    want = [0] + [next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) for a, b in zip(raws, raws[1:])]
    assert bpetrie._shared(raws) == want and bpetrie._shared([]) == []


def test_round_trip_of_repeated_and_missing_ids(spark):
    rows = [(None, "one two"), (None, "three"), (None, None), (3, "four"), (3, "four"), (3, "")]
    got = Counter((r.doc_id, r.n_tokens) for r in bpetrie.round_trip(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    _, lib = _library("byte_bpe_50k.json")
    assert got == Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_shards_of_one_id_are_dealt_to_many_tasks(spark, tmp_path):
    """Null and repeated ids: every row once, in the input's order, over several ranges."""
    _, lib = _library("word_bpe_49k.json")
    rows = [(None, f"none {k}") for k in range(300)] + [(7, "all alike")] * 300 + [(9, None), (8, "x")]
    at = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(at)
    shards = wavelet.write_shards(spark.read.parquet(at), parts=6)
    assert shards.select("part").distinct().count() >= 4
    got = sorted(wavelet.read_shards(shards).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for (i, t), r in zip(rows, got, strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
