"""Periodic run detection: recursive frequency splitting, then a lag scan of the surviving segments.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least
``max(LEAST, 2 q)`` that no neighbouring word extends.  Every word of a run has its like q words before or
after it in the run, and q is at most half the length of the segment that the run lies in.  So a word whose
nearest like in its segment is farther than half the segment is too rare to join a run: it splits the segment.
The parts are counted anew and split again until no word is too rare; parts under ``LEAST`` words go.  (Rounds
also end when one takes out under ``SETTLED`` of the words left: what splits later costs scan time only.)

What survives is scanned lag by lag, all segments of a block of texts at once.  Lags under ``LEAST`` compare
every word with the one a lag on.  A run of a longer lag q has at least q matching words in a row, which hold a
whole window ``[k l, k l + l)`` with ``l`` half of q; so only these windows are compared, by rolling hashes:
about 2 n / q a lag, n log n altogether however repetitive the text is.  Matching windows in a row are
extended to both sides by binary search, stretches with a shorter period are left out, and each run found is
verified word by word.  (The hashes have 62 bits of two primes; a miss would need such a collision.)

A task handles blocks of about ``BLOCK`` bytes; a longer text is a block of its own.  No shuffle, no state
between blocks.

Defined cases.  Words are ``[^\\x20\\x09-\\x0D]+``.  Null or empty text, or fewer than ``LEAST`` words: no runs;
the collapsed text is the words joined by single spaces (null: empty).  Repeated rows and null ids: each row
for itself.  Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import mix64, slices

LEAST = 12
SETTLED = 0.02
BLOCK = 2 << 20
CELLS = 1 << 19  # windows compared at once
PRIMES = (2147483647, 2147483629)
BASES = (1362712553, 1870041811)  # any numbers below the primes


def segments(ids: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``(start, end)`` of the segments that survive the splitting; ``ids`` and ``text`` per word, texts in a row."""
    at, part = np.arange(len(ids)), text
    n_ids = int(ids.max()) + 1 if len(ids) else 1
    while True:
        # parts: words next to each other that no split has separated
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])
        part = np.cumsum(new) - 1
        size = np.bincount(part)
        large = size[part] >= least
        at, part = at[large], part[large]
        if not len(at):
            return np.empty((0, 2), np.int64)
        key = part.astype(np.int64) * n_ids + ids[at]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        gap = np.where(same, at[order[1:]] - at[order[:-1]], len(ids))
        nearest = np.full(len(at), len(ids))
        nearest[1:] = gap
        nearest[:-1] = np.minimum(nearest[:-1], gap)
        often = np.empty(len(at), bool)
        often[order] = nearest <= size[part[order]] // 2
        kept = np.count_nonzero(often)
        if kept >= (1 - SETTLED) * len(at):
            break
        at, part = at[often], part[often]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    start = at[first]
    return np.stack([start, start + size[part[first]]], axis=1)


class Rolling:
    """Hashes of all windows of a word sequence, comparable across positions."""

    def __init__(self, x: np.ndarray):
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES):
            power = np.ones(len(x) + 1, np.uint64)
            done, step = 1, base
            while done < len(power):  # doubling: powers[done + i] = powers[i] * base ** done
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * np.uint64(step) % np.uint64(prime)
                done, step = 2 * done, step * step % prime
            value = mix64(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(prime)) % np.uint64(prime)
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(value * power[:-1] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums)
            self.powers.append(power)

    def same(self, at, lag, size) -> np.ndarray:
        """Whether the windows of ``size`` words at ``at`` and ``at + lag`` have equal hashes."""
        out = np.ones(len(at), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers):
            p = np.uint64(prime)
            here = (sums[at + size] - sums[at]) % p * powers[lag] % p
            out &= here == (sums[at + lag + size] - sums[at + lag]) % p
        return out


def _longest(test, most: np.ndarray) -> np.ndarray:
    """Elementwise the largest t <= ``most`` with ``test(t)``, which holds for 0 and up to some t."""
    low, high = np.zeros_like(most), most.copy()
    while np.any(low < high):
        mid = (low + high + 1) // 2
        ok = test(mid)
        low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
    return low


def _shorter(x_hash: Rolling, start: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Which stretches (of at least two lags) have a period that divides their lag."""
    out, rest = np.zeros(len(lag), bool), lag.copy()
    factor = 2
    while len(rest) and rest.max() > 1:
        if factor * factor > rest.max():  # what is left is one prime
            at = np.flatnonzero(rest > 1)
            d = lag[at] // rest[at]
            out[at] |= x_hash.same(start[at], d, lag[at])
            break
        at = np.flatnonzero(rest % factor == 0)
        if len(at):
            d = lag[at] // factor
            out[at] |= x_hash.same(start[at], d, lag[at])
            while len(at):
                rest[at] //= factor
                at = at[rest[at] % factor == 0]
            # a rest that is itself prime is met when its factor comes, or at the end
        prime_left = (rest > 1) & (factor * factor > rest)
        if prime_left.any():
            at = np.flatnonzero(prime_left)
            d = lag[at] // rest[at]
            out[at] |= x_hash.same(start[at], d, lag[at])
            rest[at] = 1
        factor += 1
    return out


def scan(x: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs ``(start, length, period)`` of ``x``: segments in a row, longest first, each closed by a word of its own.

    ``ends``: where each segment ends, its closing word included.
    """
    size = np.diff(ends, prepend=0) - 1
    hashes, found = Rolling(x), []
    top = int(size[0]) // 2 if len(size) else 0
    # how many words belong to segments of at least 2 lags
    reach = np.r_[0, ends][np.searchsorted(-size, -2 * np.arange(top + 1), side="right")]

    def keep(start, end, lag):
        """Stretches of words that match the one a lag on -> runs."""
        length = end - start + lag
        ok = length >= np.maximum(least, 2 * lag)
        start, length, lag = start[ok], length[ok], lag[ok]
        ok = ~_shorter(hashes, start, lag)
        found.append(np.stack([start[ok], length[ok], lag[ok]], axis=1))

    for lag in range(1, min(least, top + 1)):
        n = int(reach[lag])
        equal = np.zeros(n + 2, bool)
        equal[1 : n + 1 - lag] = x[: n - lag] == x[lag:n]
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        keep(edge[::2], edge[1::2], np.full(len(edge) // 2, lag))
    lag = least
    while lag <= top:
        half = (lag + 1) // 2
        many = max(1, CELLS // max(1, int(reach[lag]) // half))  # lags compared at once
        lags = np.arange(lag, min(top, lag + many - 1) + 1)
        lag = int(lags[-1]) + 1
        halves = (lags + 1) // 2
        count = np.maximum(0, (reach[lags] - lags) // halves)  # windows that lie, with their like, in reach
        q, h = np.repeat(lags, count), np.repeat(halves, count)
        k = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        at = k * h
        ok = np.flatnonzero((x[at] == x[at + q]) & (x[at + h - 1] == x[at + h - 1 + q]))
        ok = ok[hashes.same(at[ok], q[ok], h[ok])]
        if not len(ok):
            continue
        at, q, h = at[ok], q[ok], h[ok]
        first = np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + h[1:])]
        last = np.r_[first[1:], True]
        start, end, q, h = at[first], at[last] + h[last], q[first], h[first]
        start = start - _longest(lambda t: hashes.same(start - t, q, t), np.minimum(h, start))
        end = end + _longest(lambda t: hashes.same(end, q, t), np.minimum(h, len(x) - end - q))
        keep(start, end, q)
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    for s, n, q in out.tolist():
        if not np.array_equal(x[s : s + n - q], x[s + q : s + n]) or (s and x[s - 1] == x[s - 1 + q]) or (
                s + n < len(x) and x[s + n] == x[s + n - q]):
            raise RuntimeError("hashes of unlike words agree")
    return out


def runs(texts: list[list], least: int = LEAST) -> np.ndarray:
    """All runs ``(text, start, length, period)`` of texts given as word lists, in this order by text, start, period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    count = np.array([len(words) for words in texts], np.int64)
    base = np.cumsum(count) - count
    parts = segments(ids, np.repeat(np.arange(len(texts)), count), least)
    if not len(parts):
        return np.empty((0, 4), np.int64)
    size = parts[:, 1] - parts[:, 0]
    order = np.argsort(-size, kind="stable")
    parts, size = parts[order], size[order]
    ends = np.cumsum(size + 1)
    x = np.empty(int(ends[-1]), np.int64)
    inside = np.ones(len(x), bool)
    inside[ends - 1] = False
    begin = ends - size - 1
    x[inside] = ids[np.repeat(parts[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    x[~inside] = len(number) + np.arange(len(parts))
    out = scan(x, ends, least)
    part = np.searchsorted(begin, out[:, 0], side="right") - 1
    word = out[:, 0] - begin[part] + parts[part, 0]
    text = np.searchsorted(base, word, side="right") - 1
    # empty texts share their base with the next one; the word belongs to the last text that starts there
    out = np.stack([text, word - base[text], out[:, 1], out[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start: bigint, length: bigint, period: bigint>"


def _structs(rows: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in (1, 2, 3)], fields=list(_RUN))


def _collapse(least: int):
    def run(batches):
        for batch in batches:
            for block in slices(batch, 1, BLOCK):
                texts = [(t or b"").split() for t in block.column(1).cast(pa.binary()).to_pylist()]
                found = runs(texts, least)
                at = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                longest = np.lexsort((found[:, 3], found[:, 1], -found[:, 2], found[:, 0]))
                best = [int(longest[a]) if b > a else None for a, b in zip(at, at[1:])]
                joined = []
                for words, a, b in zip(texts, at.tolist(), at[1:].tolist()):
                    if b > a:  # a run's words but for its first period go
                        inner = np.zeros(len(words) + 1, np.int64)
                        np.add.at(inner, found[a:b, 1] + found[a:b, 3], 1)
                        np.add.at(inner, found[a:b, 1] + found[a:b, 2], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(inner)[:-1] == 0).tolist()]
                    joined.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(joined, pa.binary()).cast(pa.string()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), _structs(found)),
                     _structs(found).take(pa.array(best, pa.int64()))],
                    names=["doc_id", "collapsed", "runs", "longest"])
    return run


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row ``doc_id, collapsed, runs, longest``.

    ``runs``: every run as (start word from 0, length, period), by start, then period; ``longest`` the longest
    one (ties: smallest start, then period; null without runs); ``collapsed``: the text without the words that
    any run holds after its first period.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _collapse(least), f"doc_id long, collapsed string, runs array<{_RUN_SQL}>, longest {_RUN_SQL}")
