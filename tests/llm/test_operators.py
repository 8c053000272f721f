"""Each operator against a brute-force version, an exact round trip or held-out pages, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.llm import (bpetrie, domcrf, licenses, minhash, packing, quality, rabitq, radixdup, spans, wavelet, words)
from imprint.llm.common import components

DOCS = "doc_id long, text string, lang string, kept string, rank int, _later string"


def _texts():
    r = random.Random(7)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(w + r.choice(["", "", "", ".", ","]) for w in r.choices(vocab, k=n))

    base, passage = prose(120), prose(70)
    out = [None, "", " \n\t ", "one two three", base, base, base.replace(base.split()[40], "zzz", 1),
           prose(90) + ".\n" + passage + ". " + prose(60), prose(80) + ". " + passage + ".\n" + prose(20),
           "same line here\n" * 40, "le. " * 900, prose(6000), passage, "x" * 5000, "ha ha " * 300,
           "Émile Ünïcode ça va — 日本語 <|endoftext|> it's 3,14 \r\n\r\n  end  ", "#$%& | <b> * " * 30]
    out += [prose(r.randint(1, 150)) for _ in range(40)]
    return out + [base + " tail"] * 6


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 + 1, t, "en", "clash", i, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_minhash_is_exact_on_small_sets(spark, docs, texts, empty):
    sets = {i * 3 + 1: set(minhash.shingle_set(t).tolist()) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = _rows(minhash.near_duplicates(docs))
    assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(odd).collect()) == [
        (0, 0, True), (2, 2, True), (2, 2, True)]


def test_minhash_joins_a_group_through_its_members(spark):
    """A chain of near copies whose ends are unlike is one component, though no member is near all others."""
    r = random.Random(1)
    w = [f"w{r.randint(0, 10**9)}" for _ in range(300)]
    chain = []
    for i in range(30):
        chain.append((i, " ".join(w)))
        at = (i * 37) % 300
        w[at] = f"n{i}"
    got = _rows(minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")))
    assert {x.component_id for x in got.values()} == {0}


def test_minhash_blocks_of_a_hot_bucket(spark, monkeypatch):
    """Blocks much smaller than a bucket lose no link, whether members reach the threshold or stay just below it."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**9)}" for _ in range(200)]
    rows = []
    for i in range(40):
        w = list(base)
        for at in range(i % 3, 200, 200 // (2 if i % 2 else 6)):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = [set(minhash.shingle_set(t).tolist()) for _, t in rows]
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if c in (x, y) else c for c in root]
    assert 1 < len(set(root)) < 40
    got = _rows(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].component_id for i in range(40)] == root


def test_minhash_repeated_rows_in_the_last_pass(spark, monkeypatch):
    """Pairs that only the last pass can link, of a row that occurs once and one that occurs twice or has a second text."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    r = random.Random(4)
    rows, likes = [], []
    for k in range(12):
        base = [f"w{r.randint(0, 10**9)}" for _ in range(300)]
        hub, once = list(base), list(base)
        for at in range(0, 300, 28):
            hub[at] = f"h{k}x{at}"
        once[150] = f"o{k}"
        ids = 10 * k, 10 * k + 1, 10 * k + 2
        rows += [(ids[0], " ".join(hub)), (ids[1], " ".join(base)), (ids[2], " ".join(once)),
                 (ids[1], " ".join(base if k % 2 else [f"u{r.randint(0, 10**9)}" for _ in range(300)]))]
        likes.append([set(minhash.shingle_set(" ".join(t)).tolist()) for t in (hub, base, once)])
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    assert all(near(b, c) and not near(a, b) and not near(a, c) for a, b, c in likes)
    got = _rows(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[10 * k + 2].component_id for k in range(12)] == [10 * k + 1 for k in range(12)]


def test_forest_spans_the_likely_pairs():
    r = np.random.default_rng(2)
    sig = minhash.planes(r.integers(0, 2**32, (30, minhash.PERMS), dtype=np.uint64).astype(np.uint32))
    for i in range(30):
        if i % 5:
            sig[i] = sig[i - 1] ^ np.int64(1 << (i % 60))
    comps = np.array([i // 2 for i in range(30)])
    pairs = list(minhash._forest(np.arange(30), comps, sig))
    assert 0 < len(pairs) < 30
    root = list(comps)
    for u, v in pairs:
        assert root[u] != root[v] and minhash._differ(sig[[u]], sig[v])[0] <= minhash._MOST
        root = [root[v] if c == root[u] else c for c in root]
    assert all(root[i] == root[j] for i in range(30) for j in range(30)
               if minhash._differ(sig[[i]], sig[j])[0] <= minhash._MOST)


def test_estimate_follows_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 4000).astype(np.uint64)
    for share in (0.3, 0.75, 0.95):
        n = int(2 * 3000 * share / (1 + share))
        x, y = np.unique(a[:3000]), np.unique(np.concatenate([a[:n], r.integers(0, 2**63, 3000 - n).astype(np.uint64)]))
        p = minhash.planes(np.array([minhash.minima(x), minhash.minima(y)]))
        d = np.bitwise_or.reduce((p[0] ^ p[1]).reshape(minhash.LOW_BITS, -1), axis=0)
        same = 1 - sum(bin(int(v) & (2**64 - 1)).count("1") for v in d) / minhash.PERMS
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((same - 1 / 16) / (15 / 16) - true) < 0.12


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 9), (9, 7), (7, 5), (4, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, 7: 5, **{100 + i: 100 for i in range(41)}}


def test_radix_windows_equal_brute_force(docs, texts, empty):
    got = _rows(radixdup.remove_repeats(docs))
    for i, want in enumerate(radixdup.brute_force(texts)):
        r = got[i * 3 + 1]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
    assert radixdup.remove_repeats(empty).count() == 0


def test_radix_windows_across_chunks(spark, monkeypatch):
    r = random.Random(2)
    a = "".join(r.choices("ab", k=3000))
    texts = [a[:1500], a[700:], "b" * 900, "ab" * 500]
    monkeypatch.setattr(radixdup, "CHUNK", 64)
    raw = [t.encode() for t in texts]
    buf, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw])
    start = end - [len(x) for x in raw]
    small = radixdup.runs(buf, start, end)
    covered = sorted(p for f, n in zip(small[1], small[2]) for p in range(f, f + n))
    assert covered == [p for s, e in zip(start, end) for p in range(s, e - radixdup.WINDOW + 1)]
    got = _rows(radixdup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(4)] == radixdup.brute_force(texts)


def test_sentence_spans(docs, texts, empty):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        hashes = spans.span_hashes(*spans.sentences(spans._tokens(t or "")))[2].tolist()
        want[i * 3 + 1] = (None, 0) if t is None else spans.drop_copies(t, {h for h in hashes if h in seen})
        seen.update(hashes)
    got = _rows(spans.remove_passages(docs))
    assert want == {i: (r.text, r.n_removed) for i, r in got.items()}
    assert got[1].kept == "clash" and set(docs.columns) < set(spans.remove_passages(docs).columns)
    passage = texts[12].split()
    left = got[8 * 3 + 1].text
    assert sum(" ".join(passage[k : k + 8]) in left for k in range(len(passage) - 8)) < 20
    assert spans.remove_passages(empty).count() == 0


def _kept_words(texts, size=50):
    """Words left in each text when those of every window that occurred before go; plain tuples, no operator code."""
    seen, out = set(), []
    for t in texts:
        w = t.split()
        gone, own = set(), set()
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if x in seen or x in own:
                gone.update(range(k, k + size))
            own.add(x)
        seen |= own
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def _ragged(seed=11):
    """Texts with pasted passages of 50 to 80 words that start and end inside sentences, some in hosts without any."""
    r = random.Random(seed)

    def prose(n, ends):
        return [f"w{r.randint(0, 10**9)}" + r.choice(ends) for _ in range(n)]

    passages = [prose(n, e) for n in range(50, 81) for e in ([""], ["", "", "", "", "", "", ".", ","], [*[""] * 17, "."])]
    out = []
    for p in passages * 2 + r.sample(passages, 30):
        ends = r.choice([[""], ["", "", "", "."]])
        out.append(" ".join(prose(r.randint(0, 60), ends) + p + prose(r.randint(0, 60), ends)))
    w = prose(400, ["", "", "", "", "."])
    for k in range(20):  # near copies of one text: unlike stretches about the edits, which lie closer than a window or not
        out.append(" ".join(w))
        w[(k * 67) % 400] = f"n{k}"
    return out


def test_ragged_passages_equal_word_windows(spark):
    texts = _ragged()
    got = _rows(spans.remove_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)))
    want = _kept_words(texts)
    assert sum(len(t.split()) - len(x) for t, x in zip(texts, want)) > 10_000
    for i, w in enumerate(want[:-20]):
        assert got[i].text.split() == w, i
    for i, w in enumerate(want[-20:], len(want) - 20):  # sentences between the edits may go as well
        left = iter(w)
        assert all(x in left for x in got[i].text.split()), i
        assert (got[i].n_removed > 0) == (len(w) < 400)


def test_three_sentences_after_an_open_one(spark):
    """Two whole sentences and two partial ones are no run of three, but more than 50 words."""
    s = [" ".join(f"p{k}x{j}" for j in range(18)) for k in range(3)]
    passage = ". ".join(s)
    rows = [(1, f"one host that goes on {passage} and on here."), (2, f"another that never stops {passage} but ends.")]
    got = _rows(spans.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1].text, got[2].text) == (rows[0][1], "another that never stops but ends.")


def test_quality_counts(docs, texts, empty):
    got = _rows(quality.quality(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        three = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        lines, seen = t.split("\n"), Counter()
        dup = 0
        for line in lines:
            dup += bool(seen[line]) and bool(re.search(r"[^\x20\x09-\x0D]", line))
            seen[line] += 1
        longest, cover = 0, set()
        if len(w) < 1500:
            for a in range(len(w)):
                best = 0
                for b in range(len(w)):
                    k = 0
                    while a != b and max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                        k += 1
                    best = max(best, k)
                longest = max(longest, best)
                if best >= quality.MIN_REPEAT:
                    cover.update(range(a, a + best))
        r = got[i * 3 + 1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(three))
        assert r.base_failed == (len(w) < 50 or 100 * len(three) > 50 * len(w))
        if len(w) < 1500:
            assert (r.longest_repeat, r.covered_words) == (longest, len(cover))
    good = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert good == {i for i, r in got.items() if r.kept}
    assert quality.quality(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def test_trie_bpe_round_trip(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = _rows(bpetrie.round_trip(docs))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = got[i * 3 + 1]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpetrie.round_trip(empty).count() == 0


def _word_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_ids_equal_the_library(texts):
    odd = ["İstanbul ſ ẞ", "ΑΣ Σ", "éa é", "a\x1cb \x85c", "<|startoftext|> x", "don't 'S 12.5 ... ,", "a.​b", "x." * 3]
    assert [x.tolist() for x in words.coder(None).encode([t or "" for t in texts] + odd)] == _word_ids(texts + odd)


def test_wavelet_files(spark, docs, texts, empty):
    shards = wavelet.write_shards(docs, parts=3, shard_tokens=500)
    assert shards.count() > 3
    got = _rows(wavelet.read_shards(shards))
    start = 0
    for i, ids in enumerate(_word_ids(texts)):
        ids = ids + [2]
        r = got[i * 3 + 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(empty, parts=2)).count() == 0


def test_wavelet_rank_and_select():
    x = np.random.default_rng(4).integers(0, 40, 5000).astype(np.uint16) * 1000
    _, docs, _, m = wavelet.read_shard(wavelet.write_shard(0, [None, 7], [3000, 2000], x))
    assert docs == [None, 7] and (m.tokens() == x).all()
    for i in (0, 1, 511, 512, 513, 4999):
        assert m.access(i) == x[i]
    for t in (0, 7000, 39000, 5):
        at = np.flatnonzero(x == t)
        assert m.rank(t, 2345) == (at < 2345).sum() and m.rank(t, 5000) == len(at)
        assert [m.select(t, k) for k in range(0, len(at), 17)] == at[::17].tolist() and m.select(t, len(at)) == -1


def test_packing(docs, texts, empty):
    got = packing.pack(docs).collect()
    want = {i * 3 + 1: ids + [0] for i, ids in enumerate(_word_ids(texts))}
    bins = defaultdict(list)
    for r in got:
        part = want[r.doc_id][r.start : r.start + 2048]
        assert (r.start, r.length) == (r.piece * 2048, len(part))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(got) == sum(-(-len(v) // 2048) for v in want.values()) and len(bins) <= -(-total // 2048) + 1
    assert packing.pack(empty).count() == 0


def test_fullest_combination_is_best():
    r = random.Random(5)
    for _ in range(60):
        counts = {r.randint(1, 60): r.randint(1, 4) for _ in range(6)}
        room = r.randint(1, 150)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


def test_nearest_neighbours(spark):
    g = np.random.default_rng(6)
    v = g.standard_normal((900, 24)).round(3)
    v[5] = v[6] = v[100]
    rows = [(i, x.tolist(), "extra") for i, x in enumerate(v)]
    rows += [(2000, None, "e"), (2100, [0.0] * 24, "e"), (2200, [float("nan")] * 24, "e"), (2300, [1.0], "e"),
             (2400, [None] + [1.0] * 23, "e"), (None, [1.0] * 24, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = defaultdict(list)
    for r in rabitq.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    # a short vector counts as filled up with zeros; a row without id is found, but never asks
    ids = [*range(900), 2300, None]
    v = np.vstack([v, [1.0] + [0.0] * 23, [1.0] * 24])
    assert set(got) == {*range(0, 900, 100), 2300}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(np.cumsum((v - v[ids.index(q)]) ** 2, axis=1)[:, -1])
        d[ids.index(q)] = np.inf
        best = np.lexsort((np.arange(902), d))[:10]
        hits += len({ids[i] for i in best} & {i for i, _ in found})
        assert all(s == d[ids.index(i)] for i, s in found)
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[100][:2]] == [5, 6]
    assert rabitq.search(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_license_scan(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "/a/LICENSE", mit), (2, "/a/b/x.txt", "plain words"), (3, "/a/b/c/y.txt", f"some text.\n{gpl}\nmore text " + "w " * 90),
            (4, "/a/b/c/z.txt", None), (5, "/q/r.txt", ""), (6, None, "nothing"), (7, "/a/d/COPYING", "x " * 500 + "\n" + gpl),
            (8, "/a/d/e/f.txt", "a license to be silly is not one of the usual kinds at all"), (9, "top.txt", mit), (9, "top.txt", mit)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "id long, path string, text string, license string")
    got = {r.id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "/a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "MIT", "/a"),
                   5: (None, "MIT", ""), 6: (None, None, None), 7: ("GPL-3.0", "GPL-3.0", None),
                   8: (None, "GPL-3.0", "/a/d"), 9: ("MIT", "MIT", None)}
    assert licenses.scan(df.where("id < 0")).count() == 0
    assert not re.search("Python|Pandas|Arrow", licenses.scan(df)._jdf.queryExecution().toString())


def test_license_forms(spark):
    """SPDX lines, wrapped headers in comments, permission paragraphs and license files as whole texts."""
    gpl = ("// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General "
           "Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n"
           "// (at your option) any later version.\n\nint main() { return 0; }\n")
    wrap = lambda t: re.sub(r"(.{50,70}) ", r"\1\n", t)
    bsd = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n" + wrap(licenses._PERMIT + licenses._AS_IS)
    three = wrap(licenses._PERMIT + licenses._NAMES_OF.replace("the copyright holder", "Some Body") + licenses._AS_IS)
    rows = [(1, "/a/x.c", "// SPDX-License-Identifier: MIT\nint x;"), (2, "/b/x.c", "# SPDX-License-Identifier: GPL-3.0-only\n"),
            (3, "/c/x.c", "/* SPDX-License-Identifier: WTFPL */"), (4, "/d/x.c", gpl), (5, "/e/LICENSE", bsd),
            (6, "/f/LICENSE.txt", "Copyright 2020 Some Body\n\n" + three), (7, "/e/y.c", "int y;"),
            (8, "/g/z.c", "some words before\n\n" + wrap(licenses._ISC) + "\n\nsome words after"),
            (9, "/h/COPYING", "The MIT License\n\nCopyright (c) 2021 Any One\n\n" + wrap(licenses._MIT + licenses._MIT_REST)),
            (10, "/i/x.c", "Copyright. All rights reserved.\nReleased under the MIT License, see there."),
            (11, "/j/x.c", "Copyright. All rights reserved."), (12, "/k/LICENSE", "no words of that kind")]
    got = {r.id: (r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("GPL-3.0", None), 3: (None, None), 4: ("GPL-3.0", None), 5: ("BSD-2-Clause", None),
                   6: ("BSD-3-Clause", None), 7: ("BSD-2-Clause", "/e"), 8: ("ISC", None), 9: ("MIT", None), 10: ("MIT", None),
                   11: ("Proprietary", None), 12: (None, None)}


def test_marginals_equal_enumeration():
    import itertools

    g = np.random.default_rng(8)
    parent, own, edge = [-1, 0, 0, 1, 1], g.standard_normal(5), g.standard_normal((2, 2))
    p, z = np.zeros(5), 0.0
    for y in itertools.product((0, 1), repeat=5):
        s = np.exp(sum(own[k] * y[k] for k in range(5)) + sum(edge[y[parent[k]], y[k]] for k in range(1, 5)))
        z += s
        p += s * np.array(y)
    m, _, log_z = domcrf.marginals(parent, own, edge)
    assert np.allclose(m, p / z) and np.isclose(log_z, np.log(z))


def test_page_extraction(spark):
    model = domcrf.trained()
    wrong = total = 0
    for source in domcrf.labelled_pages(60, seed=321):
        page = domcrf.Page(source)
        m, _, _ = domcrf.marginals(page.parent, domcrf.features(page) @ model[0], model[1])
        wrong += sum(int(m[b] >= 0.5) != page.labels.get(b, 1) for b, _ in page.runs)
        total += len(page.runs)
    assert wrong <= 0.05 * total
    html = ('<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Menu</a></li></ul>'
            '</nav><!-- x --><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1><p><b>First  part<br>'
            '<p>Second\n &eacute; part with more words in it.</p></article><section class="comments"><p>Nice one, I liked it.</p>'
            '</section><footer>&copy; x</footer></body>')
    rows = [(1, "u", html), (2, None, None), (3, "u", ""), (4, "u", "<p>cut <b"), (1, "u", html)]
    got = domcrf.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert got[0].text == "Head & line\nFirst part\nSecond é part with more words in it." and got[0] == got[1]
    assert [(r.text, r.n_chars) for r in got[2:4]] == [("", 0), ("", 0)]
    assert all(r.n_chars == len(r.text) for r in got)
