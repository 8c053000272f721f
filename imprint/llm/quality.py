"""Quality rules with suffix-array repetition (operator 4).

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  Per slice of about 1 MB of documents one
suffix array of words is built by prefix doubling in numpy (the first key holds the
document, so nothing matches across documents; each round sorts only suffixes that
still share a group), with the ranks of every round kept.  Neighbours' common
prefixes come from those ranks by descent.  A suffix's deepest LCP interval has as
value the larger of its two neighbouring prefixes; it is a maximal repeated
substring unless the suffix before it carries the same repeat one word longer.  The
spans of maximal repeats of at least ``MIN_REPEAT`` words are united; a document is
rejected if they cover more than ``MAX_COVERED`` of its words or if the longest
repeat exceeds ``MAX_LONGEST`` words.

Defined cases: null text has no words (base rules fail: fewer than 50 words).
Repeated rows are returned each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import slices

MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.30, 100
BATCH_WORDS = 200_000


def suffix_repeats(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every word, the length of the longest repeat that starts there within its document.

    ``ids`` are word numbers of all documents in a row, document d being ``[start[d], end[d])``.
    """
    n = len(ids)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    doc = np.repeat(np.arange(len(start)), end - start)
    stop = end[doc]
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    s = key[order]
    head = np.append(True, s[1:] != s[:-1])
    at = np.flatnonzero(head)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    levels = [rank]
    size = np.diff(np.append(at, n))
    todo = np.sort(order[np.repeat(size > 1, size)])
    h = 1
    while len(todo):
        nxt = todo + h
        inside = nxt < stop[todo]
        second = np.full(len(todo), -1, np.int64)
        second[inside] = rank[nxt[inside]]
        k = rank[todo].astype(np.int64) * (n + 1) + second + 1
        o = np.argsort(k, kind="stable")
        k, p = k[o], todo[o]
        head = np.append(True, k[1:] != k[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(p)))
        group = k // (n + 1)
        first = np.append(True, group[1:] != group[:-1])
        base = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(p))))
        rank = rank.copy()
        rank[p] = (group + np.repeat(at, size) - base).astype(np.int32)
        levels.append(rank)
        todo = np.sort(p[np.repeat(size > 1, size)])
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < stop[a]) & (y < stop[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        length[ok] += 1 << k
    np.maximum.at(out, a, length)
    np.maximum.at(out, b, length)
    return out


def covered(repeat: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, span=None) -> np.ndarray:
    """Per document, the words in the union of repeats of at least ``least`` words.

    Only left-maximal repeats are laid down, the others lie inside them; with ``span``
    each repeat counts with its first ``span`` words only (windows of that length).
    """
    n = len(repeat)
    edge = np.zeros(n + 1, np.int64)
    i = np.flatnonzero(repeat >= least)
    if span is None and len(i):
        inner = np.zeros(n, bool)
        inner[1:] = repeat[:-1] == repeat[1:] + 1
        inner[start[start < n]] = False
        i = i[~inner[i]]
    np.add.at(edge, i, 1)
    np.add.at(edge, i + (repeat[i] if span is None else span), -1)
    hit = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    return hit[end] - hit[start]


_SYMBOLS = b"#*$%&|<>"
_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "covered_words long, longest_repeat long")


def _rules(batches):
    for batch in batches:
        for part in slices(batch, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(x) for x in facts(part.column(1).to_pylist()))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words",
                       "longest_repeat"])


def facts(texts: list[str | None]) -> list[np.ndarray]:
    """The counts of each text, in the order of the columns of ``quality``."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]
    n = np.array([len(w) for w in words], np.int64)
    chars = np.array([len(t or "") for t in texts], np.int64) - np.array(
        [len(r) - len(r.translate(None, b" \t\n\v\f\r")) for r in raw], np.int64)
    symbols = np.array([len(r) - len(r.translate(None, _SYMBOLS)) for r in raw], np.int64)
    dup = np.zeros(len(raw), np.int64)
    for k, r in enumerate(raw):
        lines = r.split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup[k] += bool(line.strip(b" \t\n\v\f\r"))
                else:
                    seen.add(line)
    three, cover, longest = (np.zeros(len(raw), np.int64) for _ in range(3))
    part = np.cumsum(n) // BATCH_WORDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        number: dict = defaultdict(itertools.count().__next__)
        total = int(n[lo:hi].sum())
        w = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words[lo:hi])), np.int64, total)
        end = np.cumsum(n[lo:hi])
        start = end - n[lo:hi]
        rep = suffix_repeats(w, start, end)
        three[lo:hi] = covered(rep, start, end, 3, 3)
        cover[lo:hi] = covered(rep, start, end, MIN_REPEAT)
        if total:
            some = np.flatnonzero(n[lo:hi])
            longest[lo + some] = np.maximum.reduceat(rep, start[some])
    return [n, chars, symbols, dup, three, cover, longest]


def _keep(at: int, max_covered: float, max_longest: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                n, _, _, _, three, cover, longest = facts(part.column(at).to_pylist())
                good = (n >= 50) & (100 * three <= 50 * n) & (cover <= max_covered * n) & (longest <= max_longest)
                yield part.filter(pa.array(good))
    return run


def keep_good(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs(text, ...)`` that the rules keep, with all their columns; no shuffle."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(
        _keep(docs.columns.index("text"), max_covered, max_longest), docs.schema)


def quality(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs(doc_id, text)`` -> the counts of each document, ``base_failed`` and ``kept``; no shuffle."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                        ).mapInArrow(_rules, _SCHEMA)
    return counts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("covered_words") <= max_covered * F.col("n_words"))
        & (F.col("longest_repeat") <= max_longest))
