"""Merkle manifest, periodic runs and exact top-k against brute force, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from imprint.llm import merkle, periodic, pivots, queries
from tests.conftest import SF001


# ---- merkle -------------------------------------------------------------------------------------

def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text) -> str:
    did, source, lang, n, _ = row
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (did, source, lang, n, text)])


def _tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _climb(levels, i, node, proof):
    for nodes in levels[:-1]:
        a = i // 3 * 3
        run = nodes[a:a + 3]
        proof += run[:i - a] + run[i - a + 1:]
        node = _h(*run[:i - a], node, *run[i - a + 1:])
        i //= 3
    return node


def _manifest(rows, altered):
    """Every row's result, by the definition; ``rows`` as (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, _leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    trees = [_tree([x[2] for x in groups[s]]) for s in names]
    top = _tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for at, (name, tree) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, r) in enumerate(groups[name]):
            proof = []
            node = _climb(top, at, _climb(tree, i, _leaf(r, altered(r)), proof), proof)
            out.append((r[0], leaf, tree[-1][0], root, _h(*proof), node, node == root))
    return sorted(out, key=str)


def _folded(r):
    even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
    return r[4].replace("\n", "") if even and r[4] is not None else r[4]


AWKWARD = [(None, None, None, None, None), (None, "a", "en", 1, "x\n"), (1, None, "en", 0, ""), (1, None, "en", 0, ""),
           (2, "a", None, 5, "é\n日本"), (3, "", "de", 2, None), (3, "", "de", 3, "other\ntext"), (-4, "a", "en", 7, "1:x"),
           (9, "lone", "en", 3, "a\nb"), (10, "Z", "en", 3, "\n\n"), (11, "ä", "en", 3, "long " * 50_000 + "\nend")]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_the_definition(spark, levels):
    r = random.Random(levels)
    rows = AWKWARD + [(i, "hot" if i % 3 else f"s{i % 7}", "en", i, f"text {i}\nline" * r.randint(0, 3))
                      for i in range(100, 330)]
    docs = spark.createDataFrame([(*x, "clash", 7) for x in rows], "doc_id long, source string, lang string, n_chars long, "
                                 "text string, tree string, chunk int").repartition(5)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    altered = F.when(even, F.replace("text", F.lit("\n"), F.lit("")))
    got = merkle.prove(docs, altered, levels=levels).collect()
    assert sorted(map(tuple, got), key=str) == _manifest(rows, _folded)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_manifest_of_small_tables(spark, n):
    rows = [(i, "s", "en", 1, f"t\n{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.prove(docs, levels=1).collect()
    assert sorted(map(tuple, got), key=str) == (_manifest(rows, lambda r: r[4]) if n else [])
    assert all(r["verified"] for r in got)


def test_folding_hashes_the_replacement_and_right_siblings_only():
    nodes = [_h(str(i)).encode() for i in range(10)]
    chunk = merkle.Chunk(nodes, merkle.levels_of(10, 3, 9))
    for i in range(10):
        want = _tree([*(x.decode() for x in nodes[:i]), "new", *(x.decode() for x in nodes[i + 1:])])[-1][0]
        left_gone = merkle.Chunk(list(nodes), merkle.levels_of(10, 3, 9))
        at = i
        for level in left_gone.nodes[:-1]:  # whatever stands to the left isn't read any more
            first = at // 3 * 3
            level[first:at] = [b"?"] * (at - first)
            at //= 3
        assert chunk.fold(i, b"new").decode() == left_gone.fold(i, b"new").decode() == want


# ---- periodic runs ------------------------------------------------------------------------------

def _runs(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, 2 * q) and not any(
                    all(words[t] == words[t + p] for t in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic_text(r):
    words = [str(r.randrange(r.choice([1, 2, 3, 6, 40]))) for _ in range(r.choice([0, 3, 11, 12, 13, 60, 170]))]
    for _ in range(r.randint(0, 2)):
        if len(words) > 20:
            a = r.randrange(len(words))
            p = 1 + (len(words) - a) // r.randint(2, 9)
            e = r.randint(a, len(words))
            words = [w if not a <= i < e else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(150):
        texts = [_periodic_text(r) for _ in range(r.randint(0, 5))]
        want = [(k, *x) for k, words in enumerate(texts) for x in _runs(words)]
        assert [tuple(x) for x in periodic.runs(texts).tolist()] == want


def test_scan_alone_finds_what_the_splitting_leaves():
    """No splitting: one segment for a whole text."""
    r = random.Random(8)
    for _ in range(60):
        words = _periodic_text(r)
        if len(words) >= 12:
            ids = np.array([int(w) for w in words] + [99])
            got = periodic.scan(ids, np.array([len(ids)]))
            assert sorted(map(tuple, got.tolist()), key=lambda x: (x[0], x[2])) == _runs(words)


def test_splitting_takes_out_rare_words_only():
    r = random.Random(2)
    for _ in range(60):
        words = _periodic_text(r)
        ids = np.array([int(w) for w in words], np.int64)
        parts = periodic.segments(ids, np.zeros(len(ids), np.int64))
        for start, size, _ in _runs(words):
            assert any(a <= start and start + size <= b for a, b in parts.tolist())


def test_collapse_on_awkward_rows(spark):
    texts = [None, "", " \n\t ", "a " * 11, "a " * 12, "one two three " * 9 + "end", "x" * 9000, "é ü\x0bé ü\x0c" * 7,
             "    " * 12, "w " * 70_000, "\n".join(f"line {i % 5} of text" for i in range(40))]
    rows = [(i if i % 3 else None, t, "c", 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, at int").repartition(3)
    got = sorted(((r["doc_id"], r["collapsed"], [tuple(x) for x in r["runs"]], r["longest"] and tuple(r["longest"]))
                  for r in periodic.collapse(docs).collect()), key=str)
    want = []
    for did, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = [(0, len(words), 1)] if len(words) > 50_000 else _runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        want.append((did, " ".join(w for i, w in enumerate(words) if i not in gone), found, best))
    assert got == sorted(want, key=str)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_periodic_query_against_its_contract(spark):
    table = pq.read_table(f"{SF001}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic(spark, SF001).collect()}
    planted = 0
    for row in table:
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 900:
            continue  # brute force is quadratic
        found = _runs(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert got[row["doc_id"]] == (
            row["doc_id"], len(found), *best, 1000 * best[1] // best[2] if found else None,
            _h(*[f"{s},{m},{q}\n" for s, m, q in found]), _h(" ".join(w for i, w in enumerate(words) if i not in gone)))
    assert planted > 5 and len(got) == len(table)


# ---- exact top-k --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, id string, cell int"


def _top(rows, k):
    fine = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in fine:
        if i is not None and i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        found = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1), c is None, c or 0)
                       for c, w in fine if c != q)[:k]
        out += [(q, rank, None if none else c, -s) for rank, (s, none, c) in enumerate(found, 1)]
    return sorted(out, key=lambda r: r[:2])


def _search(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], VECTORS).repartition(3)
    return pivots.search(df, F.col("vec_id") % 20 == 0, **kw)


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + r.normal(size=16) * 0.05).tolist()) for i in range(700)]
    rows += [(2000 + i, [0.5] * 16) for i in range(300)]  # a hot vector, ties by id
    got = _search(spark, rows, k=20, block=64, chunk=16)
    assert [tuple(x[:4]) for x in got.orderBy("query_id", "rank").collect()] == _top(rows, 20)
    share = got.select("query_id", "n_evaluated").distinct().agg(F.avg("n_evaluated")).first()[0] / len(rows)
    assert share < 0.6  # clustered rows: the pivot table rules out most of those of other clusters


def test_top_k_on_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (20, [0.1]), (40, []), (60, None), (80, [1.0, None]), (100, [inf, 1.0]), (120, [nan]),
            (None, [1.0, 2.0]), (None, [3.0]), (1, [0.0, 0.0]), (2, [-0.01, 0.999]), (20, [0.1]), (20, [0.05, 9.0]),
            (3, [3e38, 3e38]), (140, [-3e38, 1.0]), (5, [1e6, 1e6, 1e6]), (160, [1e6, -1e6, 12345.678])]
    for k in (1, 3, 50):
        got = [tuple(x[:4]) for x in _search(spark, rows, k=k).orderBy("query_id", "rank").collect()]
        assert got == _top(rows, k)
    assert _search(spark, [], k=3).count() == 0
    assert _search(spark, [(1, [1.0]), (2, [2.0])], k=3).count() == 0
    assert _search(spark, [(20, [1.0])], k=3).count() == 0


def test_bounds_never_rule_out_a_neighbour():
    r = np.random.default_rng(9)
    x = np.floor(r.normal(size=(500, 8)) * 64)
    t = pivots.Table(np.empty((0, 8)), 8, float((x * x).sum(axis=1).max()))
    t.pivots = pivots.farthest_first(t._more(x[:100]), 32)
    dx, dq = t.distances(x), t.distances(x, query=True)
    steps, norm, score = np.abs(dq[:, None] - dx[None]).max(axis=2), (x * x).sum(axis=1), x @ x.T
    assert np.all(t.most(steps, norm[:, None]) >= score)
    for q in range(100):  # a row that reaches a floor is within its limit
        assert all(steps[q, i] <= t.limit(score[q, i], norm[q]) for i in range(500))
    assert len(np.unique(t.pivots, axis=0)) == 32
