"""Byte-level BPE by prefix-sharing trie traversal (operator 3).

The BPE encoding of a prefix ends in one certain token, and two neighbours in an
encoding are a pair whose joint text encodes to just these two.  So the state of a
prefix is its last token: the only vocabulary token that ends there and fits the
state where it begins.  Distinct words are put into a trie, held as sorted words
with their common prefixes, which is its depth-first order; walking it keeps the
states of the current path, so a shared prefix is computed once.

Work is per task: each batch's new words form a trie, and a bounded memo keeps the
encodings for later batches and tasks of the same worker; when it is full it becomes the
old one, from which words used again move over.  No shuffle.

Special tokens in the text are matched as the tokenizers library does by default.
Defined cases: null text is empty; repeated rows are returned each; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import slices

_SPACE = r"[\t\n\v\f\r \x85\xa0  -     　]"
_SOLID = _SPACE.replace("[", "[^", 1)
_CHUNKS = re.compile(f" ?{_SOLID}+|{_SPACE}+(?!{_SOLID})|{_SPACE}+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


# marks that form one piece of their own after letters (an apostrophe may begin one with letters)
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def _pieces(text: str, word: str) -> list[str]:
    """The pieces of ``text``: a word, or one after a space."""
    stem = word.rstrip(_MARKS)
    if not stem.isalpha():
        return _PIECES.findall(text)
    return [text] if len(stem) == len(word) else [text[: len(stem) - len(word)], word[len(stem) :]]


def _units(text: str) -> list[str]:
    """``text`` cut where no piece crosses; a unit after a line end stands alone, any other follows one space."""
    if text.replace("\n", " ").split(" ") != text.split():  # other or repeated white space needs the whole pattern
        return ["\n" + c for c in _CHUNKS.findall(text)]
    return ("\n" + text.replace("\n", " \n\n \n")).split(" ")


LONGEST = 64  # letters of a unit that a memo keeps, so that its bytes are bounded


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class TrieBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, memo: int = 350_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = {t: bytes(letter[c] for c in t) for t in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.id_of = {raw[t]: i for t, i in ids.items()}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]))
        for t, i in ids.items():
            self.bytes_of[i] = raw[t]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merge = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[ids[a], ids[b]] = (rank, ids[a + b])
        self.tree = {i: (*pair, rank) for pair, (rank, i) in self.merge.items()}  # token -> its halves and their rank
        # every token has one pair, learnt after those of its halves: then ranks tell when a merge happens
        self.ranked = len(self.tree) == len(self.merge) and all(
            half not in self.tree or self.tree[half][2] < rank for *halves, rank in self.tree.values() for half in halves)
        self.whole: dict[int, bool] = {}
        # trie of the tokens: (node, byte) -> node; per node its longest proper suffix that is a node, and the tokens
        # that end there, (length, id), longest first
        self.next: dict[int, int] = {}
        spelt: list[int | None] = [None]
        for token, i in self.id_of.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.next:
                    self.next[key] = len(spelt)
                    spelt.append(None)
                node = self.next[key]
            spelt[node] = i
        self.suffix, self.ends = [0] * len(spelt), [()] * len(spelt)
        level = [0]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        while level:
            below = []
            for node in level:
                for byte, child in children.get(node, ()):
                    if node:
                        self.suffix[child] = self.step(self.suffix[node], byte)
                    own = () if spelt[child] is None else ((len(self.bytes_of[spelt[child]]), spelt[child]),)
                    self.ends[child] = own + self.ends[self.suffix[child]]
                    below.append(child)
            level = below
        self.steps: dict[int, int] = dict(self.next)
        self.fits: dict[int, bool] = {}
        self.limit = memo
        # unit -> its decimal ids joined by commas: the memo, and the one before it
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.spelling = dict(zip(self.decimal, self.bytes_of))

    def merged(self, text: bytes) -> list[int]:
        """Plain BPE of a short byte string: used for pairs of tokens."""
        ids = [self.id_of[text[k : k + 1]] for k in range(len(text))]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge),
                       default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def step(self, node: int, byte: int) -> int:
        """The node of the longest suffix of ``node``'s bytes and ``byte`` that begins a token."""
        while node and (node << 8 | byte) not in self.next:
            node = self.suffix[node]
        return self.next.get(node << 8 | byte, 0)

    def _step(self, key: int) -> int:
        if len(self.steps) >= 2_000_000:
            self.steps = dict(self.next)
        node = self.steps[key] = self.step(key >> 8, key & 255)
        return node

    def _whole(self, token: int) -> bool:
        """Whether the token's bytes encode to it."""
        if token not in self.whole:
            self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return self.whole[token]

    def _edge(self, token: int, half: int) -> list[tuple[int, float]]:
        """The tokens that end a whole token (``half`` 1; 0: begin it) while it is merged, each with the rank that ends it."""
        edge = [(token, float("inf"))]
        while token in self.tree:
            halves = self.tree[token]
            token = halves[half]
            edge.append((token, halves[2]))
        return edge

    def _apart(self, left: int, right: int) -> bool:
        """Whether the joint text of two whole tokens encodes to these two: no merge across happens first."""
        if not self.ranked:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        merge, begins = self.merge.get, self._edge(right, 0)
        for x, x_ends in self._edge(left, 1):
            for y, y_ends in begins:
                found = merge((x, y))
                # of equal pairs the one further left is merged first
                if found and found[0] < x_ends and found[0] <= y_ends:
                    return False
        return True

    def _fit(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: nothing) in an encoding; kept in ``fits``."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        got = self._whole(token) and (last < 0 or self._apart(last, token))
        self.fits[last << 20 | token] = got
        return got

    def walk(self, words: set[str]) -> dict[str, str]:
        """Encodings of distinct words (decimal ids joined by commas), by one depth-first walk over their trie."""
        out = {}
        state, at = [-1], [0]  # per byte of the path: last token, node
        ends, fits, size, decimal, steps = self.ends, self.fits.get, self.bytes_of, self.decimal, self.steps.get
        order = sorted(words)  # by code points, which is the order of the bytes
        raws = [w.encode("utf-8", "surrogatepass") for w in order]
        for word, raw, k in zip(order, raws, _shared(raws)):
            del state[k + 1 :], at[k + 1 :]
            node = at[k]
            for byte in raw[k:] if k else raw:
                key = node << 8 | byte
                node = steps(key)
                if node is None:
                    node, steps = self._step(key), self.steps.get
                at.append(node)
                for length, t in ends[node]:
                    last = state[-length]  # -1 at the word's start
                    ok = fits(last << 20 | t)
                    if ok or ok is None and self._fit(last, t):
                        state.append(t)
                        break
            end = len(raw)
            t = state[end]
            if len(size[t]) == end:
                out[word] = decimal[t]
                continue
            ids = []
            while end:
                t = state[end]
                ids.append(decimal[t])
                end -= len(size[t])
            ids.reverse()
            out[word] = ",".join(ids)
        return out

    def _learn(self, units: set[str]) -> dict[str, str]:
        """Encodings of units that the memo doesn't hold; it keeps them from now on, but for long ones."""
        now, cut, pieces, before = {}, [], set(), self.old.get
        for unit in units:
            known = before(unit)
            if known is not None:
                now[unit] = known
                continue
            alone = unit[0] == "\n"
            word = unit[1:] if alone else unit
            if alone and word in self.special:
                now[unit] = self.decimal[self.special[word]]
                continue
            ps = _pieces(word if alone else " " + word, word)
            cut.append((unit, ps))
            pieces.update(ps)
        lines = self.walk(pieces)
        for unit, ps in cut:
            now[unit] = lines[ps[0]] if len(ps) == 1 else ",".join([lines[p] for p in ps])
        if len(self.memo) + len(now) > self.limit:
            self.old, self.memo = self.memo, {}
        self.memo.update(now)
        for unit in units:
            if len(unit) > LONGEST:
                del self.memo[unit]
        return now

    def encode(self, texts: list[str]) -> list[str]:
        """Per text the decimal ids joined by commas."""
        jobs, new, get = [], set(), self.memo.get
        for text in texts:
            units = []
            for seg in self._split.split(text) if self._split and "<|" in text else [text]:
                if seg in self.special:
                    units.append("\n" + seg)
                elif seg:
                    units += _units(seg)
            known = list(map(get, units))
            new.update(compress(units, map(is_, known, repeat(None))))
            jobs.append((units, known))
        now = self._learn(new)
        return [",".join([now[u] if k is None else k for u, k in zip(units, known)]) for units, known in jobs]

    def decode(self, line: str) -> bytes:
        """UTF-8 bytes of the text of decimal ids joined by commas; ill-formed sequences become U+FFFD."""
        raw = b"".join(map(self.spelling.__getitem__, line.split(","))) if line else b""
        return raw.decode("utf-8", "replace").encode("utf-8")


def _shared(raws: list[bytes], width: int = 32) -> list[int]:
    """Per sorted word the bytes that it shares with the one before it."""
    if not raws:
        return []
    head = np.array(raws, f"S{width}").view(np.uint8).reshape(-1, width)
    same = head[1:] == head[:-1]
    sizes = np.array([len(r) for r in raws])
    shared = [0, *np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)),
                             np.minimum(sizes[1:], sizes[:-1])).tolist()]
    for k in np.flatnonzero(np.array(shared) == width).tolist():
        a, b, n = raws[k - 1], raws[k], width
        while n < len(a) and n < len(b) and a[n] == b[n]:
            n += 1
        shared[k] = n
    return shared


_LOADED: dict[str, TrieBPE] = {}


def _coder(path: str | None) -> TrieBPE:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = TrieBPE(path)
    return _LOADED[path]


def _codes(path: str | None, size: int = 4 << 20):
    def run(batches):
        coder = _coder(path)
        for batch in batches:
            for part in slices(batch, 1, size):
                n, ids_sha, text_sha = [], [], []
                for line in coder.encode([t or "" for t in part.column(1).to_pylist()]):
                    n.append(line.count(",") + 1 if line else 0)
                    ids_sha.append(hashlib.sha256(line.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(line)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``; ``path``: vocabulary file."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(_codes(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
