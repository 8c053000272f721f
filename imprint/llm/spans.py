"""Repeated passages by sliding sentence spans and word windows (operator 5).

A text is cut into sentences: a word that ends in ``.``, ``!`` or ``?`` and a line
end close one; a sentence of more than 20 words is cut further after words chosen
by their hash.  Every run of consecutive sentences is hashed: from each sentence the
shortest run of at least 3 sentences and 12 words.  So is every window of 50 words,
wherever it starts, so a passage of 50 words and more is found to the word, whatever
its hosts do around it.  A run or window that occurs in a document with a smaller id,
or earlier in its own document, is a non-first copy; the words that it covers go.

One scan emits each document's distinct sentence runs and, for windows, stretches:
consecutive windows with the same least hash of 16 words, its anchor, about one row
in 18 words.  Equal windows have equal anchors.  A partial aggregate finds the smallest
document of every run and stretch and an equi-join (skewed sides may be split) the
documents that hold later copies, whose words all go.  Only where an anchor has unlike
stretches (at the ends of a passage, around an edit) the first document of each of them
gives its single windows, which are compared in the same way.  Only documents that may
change are shuffled with their text.  All are compared by 64-bit hashes of their words.

Defined cases: null text is kept null; documents too short for a run stay as they
are; rows of one id count as one document; without an id each text is a document of
its own, before those with ids from 0 (equal ones count as one).  A changed text is
stripped.  Other columns pass through.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from imprint.llm.common import HashOf, freeing, fresh, mark, mix64, save, slices

SENTENCES, WORDS, LONG = 3, 12, 20
WINDOW, ANCHOR = 50, 16
_M = np.uint64(0x9E3779B97F4A7C13)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))


class _Words(HashOf):
    """Hash of a word; its lowest bit tells whether the word closes a sentence."""

    def hash(self, word):
        return (super().hash(word) & ~1) | (word[-1] in b".!?")


_WORDS = _Words()
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_TOKEN = re.compile(rb"\n|[^\x20\x09-\x0D]+")


def _powers(base, n):
    p = np.full(n + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(_M, 4096), _powers(_MINV, 4096)


def sentences(tokens: list[bytes], sizes: list[int] | None = None):
    """Tokens (``\\x00`` or a newline for line ends) -> word hashes, and [first, last) word numbers of each sentence.

    ``sizes``: the tokens of each of several texts in a row; then also the text of each word.
    """
    h = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    breaks = np.fromiter((t == b"\x00" or t == b"\n" for t in tokens), bool, len(tokens))
    text = np.repeat(np.arange(len(sizes)), sizes) if sizes is not None else np.zeros(len(tokens), np.int64)
    word = ~breaks
    last = (h & np.uint64(1)).astype(bool)
    last[:-1] |= breaks[1:]
    h, last, text = h[word], last[word], text[word]
    if not len(h):
        none = np.empty(0, np.int64)
        return (h, none, none) if sizes is None else (h, none, none, none)
    last[:-1] |= text[1:] != text[:-1]
    last[-1] = True
    sid = np.cumsum(last) - last
    size = np.bincount(sid)
    last = last | ((size[sid] > LONG) & ((h >> np.uint64(8)) & np.uint64(7) == 0))
    ends = np.flatnonzero(last) + 1
    found = h, np.append(0, ends[:-1]), ends
    return found if sizes is None else (*found, text)


def _hashes(h, a, b, kind):
    """Hashes of the words ``a`` up to ``b`` (arrays); unlike for unlike kinds."""
    global _POW
    if len(h) >= len(_POW[0]):
        _POW = _powers(_M, 2 * len(h)), _powers(_MINV, 2 * len(h))
    total = np.append(np.uint64(0), np.cumsum(h * _POW[0][: len(h)], dtype=np.uint64))
    s = (total[b] - total[a]) * _POW[1][a] + ((b - a) * 4 + kind).astype(np.uint64) * _M
    return mix64(s).view(np.int64)


def _sentence_runs(h, starts, ends, text=None):
    """(first word, end word, hash) of every run of sentences within a text."""
    n = len(ends)
    i = np.arange(n)
    j = np.maximum(i + SENTENCES - 1, np.searchsorted(ends, starts + WORDS))
    i, j = i[j < n], j[j < n]
    if text is not None:
        inside = text[starts[i]] == text[starts[j]]
        i, j = i[inside], j[inside]
    a, b = starts[i], ends[j]
    return a, b, _hashes(h, a, b, 0)


def _windows(h, text=None):
    """(first word, end word, hash) of every window within a text."""
    a = np.arange(max(len(h) - WINDOW + 1, 0))
    if text is not None and len(a):
        a = a[text[: len(a)] == text[WINDOW - 1 :]]
    return a, a + WINDOW, _hashes(h, a, a + WINDOW, 1)


def _stretches(h, text=None):
    """(first word, end word, hash, anchor) of consecutive windows with the same anchor within a text."""
    if len(h) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none
    a = np.arange(len(h) - ANCHOR + 1)
    least, width, wide = _hashes(h, a, a + ANCHOR, 2), 1, WINDOW - ANCHOR + 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    new = np.append(True, least[1:] != least[:-1])
    if text is None:
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(least)) - 1 + WINDOW
    else:
        here = text[: len(least)]
        whole = here == text[WINDOW - 1 :]  # a window that a text's end cuts is none
        new[1:] |= (here[1:] != here[:-1]) | (whole[1:] != whole[:-1])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(least)) - 1 + WINDOW
        a, b = a[whole[a]], b[whole[a]]
    return a, b, _hashes(h, a, b, 3), least[a]


def span_hashes(h, starts, ends):
    """(first word, end word, hash) of every run of sentences and every window."""
    return tuple(map(np.concatenate, zip(_sentence_runs(h, starts, ends), _windows(h))))


def _tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").replace(b"\n", b" \x00 ").split()


def _word_starts(raw: bytes) -> list[int]:
    """Where the words of a text begin (lone ``\\x00`` are line ends, as in ``_tokens``)."""
    if b"\x00" in raw:
        return [m.start() for m in _TOKEN.finditer(raw) if m.group() not in (b"\n", b"\x00")]
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    return np.flatnonzero(~space & np.append(True, space[:-1])).tolist()


def _repeats(s):
    """Which of the hashes occur earlier among them."""
    again = np.ones(len(s), bool)
    again[np.unique(s, return_index=True)[1]] = False
    return again


def _distinct(text, s):
    """(index, repeated) of the first of equal hashes of a text."""
    order = np.lexsort((s, text))
    t, u = text[order], s[order]
    first = np.append(True, (t[1:] != t[:-1]) | (u[1:] != u[:-1]))[: len(s)]
    at = np.flatnonzero(first)
    return order[at], np.diff(np.append(at, len(s))) > 1


def _spans(batches):
    """(h, did, own, anchor): sentence runs (without an anchor) and stretches; own: repeated within the text."""
    for batch in batches:
        for part in slices(batch, 1):
            did = part.column(0).to_numpy()
            lists = [_tokens(t or "") for t in part.column(1).to_pylist()]
            h, starts, ends, text = sentences(list(itertools.chain.from_iterable(lists)), [len(x) for x in lists])
            a, _, r = _sentence_runs(h, starts, ends, text)
            at, often = _distinct(text[a], r)
            ra, rs = text[a][at], r[at]
            a, _, w = _windows(h, text)
            at, twice = _distinct(text[a], w)
            again = np.zeros(len(lists), bool)
            again[text[a][at[twice]]] = True
            a, _, s, g = _stretches(h, text)
            at, _ = _distinct(text[a], s)
            sa, ss, g = text[a][at], s[at], g[at]
            no_anchor = np.arange(len(ra) + len(sa)) < len(ra)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(rs, ss)), pa.array(did[np.append(ra, sa)]), pa.array(np.append(often, again[sa])),
                pa.array(np.append(np.zeros(len(ra), np.int64), g), mask=no_anchor)], names=["h", "did", "own", "anchor"])


def _open_windows(batches):
    """Rows (did, text, list of stretches) -> (h, did): the windows of these stretches."""
    for batch in batches:
        for did, text, some in zip(*(c.to_pylist() for c in batch.columns)):
            h = sentences(_tokens(text or ""))[0]
            a, b, s, _ = _stretches(h)
            pick = np.isin(s, np.array(some, np.int64))
            inside = np.zeros(len(h) + 1, np.int32)
            np.add.at(inside, a[pick], 1)
            np.add.at(inside, b[pick] - WINDOW + 1, -1)
            first, _, w = _windows(h)
            w = np.unique(w[np.cumsum(inside)[first] > 0])
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(np.full(len(w), did, np.int64))], names=["h", "did"])


_ENDS = r"[.!?](?=[\x20\x09-\x0D]|\z)|[^\x20\x09-\x0D](?=[\x20\x09\x0B-\x0D]*(?:\n|\z))"


def drop_copies(text: str, later) -> tuple[str, int]:
    """The text without words covered by runs, windows or stretches in ``later`` or by runs or windows seen
    earlier in the text; also the number of sentences, or pieces of long ones, that lost words."""
    h, starts, ends = sentences(_tokens(text))
    known = np.fromiter(later, np.int64)
    gone = np.zeros(len(h) + 1, np.int32)
    for (a, b, s), alone in ((_sentence_runs(h, starts, ends), True), (_windows(h), True), (_stretches(h)[:3], False)):
        copy = np.isin(s, known)
        if alone:
            copy |= _repeats(s)
        np.add.at(gone, a[copy], 1)
        np.add.at(gone, b[copy], -1)
    cut = np.cumsum(gone[:-1]) > 0
    if not cut.any():
        return text, 0
    raw = text.encode("utf-8", "surrogatepass")
    place = [*_word_starts(raw), len(raw)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], cut, [True])).astype(np.int8)))
    kept = raw[: place[0]] + b"".join(raw[place[k] : place[e]] for k, e in zip(edge[::2].tolist(), edge[1::2].tolist()))
    return kept.decode("utf-8", "surrogatepass").strip(), int(np.logical_or.reduceat(cut, starts).sum())


def _drop(at: int, names: list[str]):
    """Replaces the text in column ``at``; the last column, the list of later copies, becomes the number of sentences hit."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                done = [(t, 0) if t is None else drop_copies(t, x.values.to_numpy() if x.is_valid else ())
                        for t, x in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1))]
                columns = list(part.columns[:-1])
                columns[at] = pa.array([x[0] for x in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], pa.int64())], names=names)
    return run


def remove_passages(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)`` with ``text`` cut, and two last columns that tell
    what was done: ``n_sentences`` of the text by marks and line ends, and ``n_removed``, the sentences, or pieces
    of long ones, that lost words; their names get underscores added if ``docs`` has such columns already."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    did, later_, flag, n_all, n_gone = (fresh(c, docs) for c in ("_did", "_later", "_marked", "n_sentences", "n_removed"))
    # without an id each text is a document of its own, with a negative number
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63))))
    spans = save(docs.select(key.alias("did"), "text").mapInArrow(
        freeing(_spans), "h long, did long, own boolean, anchor long"), "spans")
    # written first, here and below: a join with a bare exchange on both sides lets Spark split a hot run
    seen = save(spans.groupBy("h").agg(F.min("did").alias("a"), F.max("did").alias("b"), F.min("anchor").alias("anchor")),
                "spans-seen")
    unlike = save(seen.where("anchor is not null").groupBy("anchor").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
                  .where("lo <> hi").select("anchor"), "spans-unlike")
    some = save(seen.join(unlike, "anchor").groupBy(F.col("a").alias(did)).agg(F.collect_set("h").alias(later_)),
                "spans-open")
    wide = mark(docs.select(key.alias(did), "text"), some, [did], flag).where(F.col(flag)).join(some, did)
    windows = save(wide.select(did, "text", later_).mapInArrow(freeing(_open_windows), "h long, did long"), "spans-windows")
    both = spans.select("h", "did").join(seen.where("a < b").select("h", "a"), "h")
    first = save(windows.groupBy("h").agg(F.min("did").alias("a"), F.max("did").alias("b")).where("a < b")
                 .select("h", "a"), "spans-first")
    later = both.unionByName(windows.join(first, "h")).where("did > a").select("did", "h")
    lists = save(later.unionByName(spans.where("own").select("did", F.lit(None).cast("long").alias("h")).distinct())
                 .groupBy("did").agg(F.collect_set("h").alias("later")), "spans-later")
    lists = lists.select(F.col("did").alias(did), F.col("later").alias(later_))
    rows = mark(docs.withColumn(did, key), lists, [did], flag)
    rows = rows.withColumn(n_all, F.coalesce(F.regexp_count("text", F.lit(_ENDS)), F.lit(0)).cast("long"))
    same = rows.where(~F.col(flag)).select(*docs.columns, n_all, F.lit(0).cast("long").alias(n_gone))
    schema = T.StructType([*docs.schema.fields, T.StructField(n_all, T.LongType()), T.StructField(n_gone, T.LongType())])
    cut = rows.where(F.col(flag)).join(lists, did, "left").select(*docs.columns, n_all, later_).mapInArrow(
        freeing(_drop(docs.columns.index("text"), schema.names)), schema)
    return same.unionByName(cut)
