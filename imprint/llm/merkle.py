"""Merkle dataset manifest: a SHA midstate tree over rows, by source, and proofs folded from its states.

A row is a leaf: the hash of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
The leaves of a source, in ascending id order, are the lowest level of its tree: ``arity`` consecutive nodes
become their hash, level by level, until one node remains, the subroot.  The subroots, in source order, give
the root likewise.

While a parent is hashed, a copy of the hash state before each child's slot is retained.  Folding a
replacement into a tree resumes the state before the replaced slot, so it hashes the replacement and its
right siblings only, never what stands to the left.

Levels are not one job each: a task takes up to ``arity ** LEVELS`` consecutive nodes of a source at once, and
hands one node to the next round, so n leaves take log(n) / log(6561) rounds, a hot source is many such
chunks, and a task holds one chunk with its states.  Going down again, each chunk gets one header row with the
siblings above it, from which it retains one state a level for all of its leaves.  Texts are hashed in the JVM
and never shuffled; a row of a chunk has an id and at most two digests.

Defined cases.  Null source: a source of its own, before all others.  Null id: before all other ids of its
source.  Repeated ids: by leaf, so repeated rows are equal neighbouring leaves, each with its own proof.
Null and empty texts are unlike (``-`` and ``0:``).  A lone leaf is its subroot, a lone subroot the root, and
their proofs hold no siblings.  Empty table: no rows.  Columns other than ``fields`` play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import save

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
LEVELS = 8  # levels that one task builds at once: chunks of 3 ** 8 nodes
ROWS_PER_TASK = 500_000


def digest(fields: dict[str, Column]) -> Column:
    """The leaf of a row, given its fields by name in their order."""
    def part(value):
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(v) for v in fields.values()]), 256)


class Chunk:
    """Up to ``levels`` levels above consecutive nodes, with the hash states before each child's slot."""

    def __init__(self, nodes: list[bytes], levels: int, arity: int = ARITY):
        self.arity, self.nodes, self.states = arity, [nodes], []
        for _ in range(levels):
            below, above, states = self.nodes[-1], [], []
            for at in range(0, len(below), arity):
                parent = hashlib.sha256()
                for child in below[at : at + arity]:
                    states.append(parent.copy())
                    parent.update(child)
                above.append(parent.hexdigest().encode())
            self.nodes.append(above)
            self.states.append(states)

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """Per level the left and the right siblings of node ``i``, each joined."""
        out = []
        for nodes in self.nodes[:-1]:
            first = i // self.arity * self.arity
            out.append((b"".join(nodes[first:i]), b"".join(nodes[i + 1 : first + self.arity])))
            i //= self.arity
        return out

    def fold(self, i: int, node: bytes) -> bytes:
        """What the top becomes if ``node`` stands in place of node ``i``."""
        for nodes, states in zip(self.nodes, self.states):
            state = states[i].copy()
            state.update(node)
            for right in nodes[i + 1 : i // self.arity * self.arity + self.arity]:
                state.update(right)
            node = state.hexdigest().encode()
            i //= self.arity
        return node


def levels_of(n: int, arity: int, most: int) -> int:
    """Levels above ``n`` nodes, ``most`` at most."""
    k = 0
    while n > 1 and k < most:
        n, k = -(-n // arity), k + 1
    return k


def _runs(batches):
    """Tables of equal ``tree`` and ``chunk`` from rows sorted by both."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        held = held.combine_chunks()
        if len(held) < 2:
            continue
        tree, chunk = held.column("tree").chunk(0), held.column("chunk").to_numpy()
        other = np.asarray(pc.not_equal(tree.slice(1), tree.slice(0, len(tree) - 1))) | (chunk[1:] != chunk[:-1])
        cuts = [0, *(np.flatnonzero(other) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None and len(held):
        yield held


def _by_chunk(rows: DataFrame, arity: int, levels: int, n_rows: int) -> DataFrame:
    """Rows of a chunk together and in order, headers (``pos`` -1, chunk given) first."""
    width = arity**levels
    slots = rows.sparkSession.sparkContext.defaultParallelism
    return (rows.withColumn("chunk", F.coalesce("chunk", F.expr(f"pos div {width}")) if "chunk" in rows.columns
                            else F.expr(f"pos div {width}"))
            .repartition(max(slots, n_rows // ROWS_PER_TASK + 1), "tree", "chunk")
            .sortWithinPartitions("tree", "chunk", "pos"))


def _tops(arity: int, levels: int):
    def run(batches):
        out = []
        for t in _runs(batches):
            n = t.column("n")[0].as_py()
            nodes = [x.encode() for x in t.column("node").to_pylist()]
            top = Chunk(nodes, levels_of(n, arity, levels), arity).nodes[-1][0]
            out.append((t.column("tree")[0].as_py(), t.column("chunk")[0].as_py(), -(-n // arity**levels), top.decode()))
            if len(out) == 4096:
                yield _nodes(out)
                out = []
        if out:
            yield _nodes(out)
    return run


def _nodes(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
        pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["tree", "pos", "n", "node"])


_NODES = "tree string, pos long, n long, node string"
_PATH = "lefts array<string>, rights array<string>, subroot string"


def _build(nodes: DataFrame, most: int, trees: int, n_rows: int, arity: int, levels: int) -> list[DataFrame]:
    """``nodes(tree, pos, n, node)``, and those of every round above, up to one node a tree."""
    out = [nodes]
    while most > 1:
        rows = _by_chunk(out[-1].select("tree", "pos", "n", "node"), arity, levels, n_rows)
        out.append(save(rows.mapInArrow(_tops(arity, levels), _NODES), "merkle-nodes"))
        most, n_rows = -(-most // arity**levels), n_rows // arity**levels + trees
    return out


def _down(arity: int, levels: int):
    """Headers and nodes of chunks -> the path above each node."""
    def run(batches):
        for t in _runs(batches):
            head, rows = t.slice(0, 1).to_pylist()[0], t.slice(1)
            nodes = [x.encode() for x in rows.column("node").to_pylist()]
            chunk = Chunk(nodes, levels_of(rows.column("n")[0].as_py(), arity, levels), arity)
            lefts, rights = [], []
            for i in range(len(nodes)):
                path = chunk.siblings(i)
                lefts.append([a.decode() for a, _ in path] + head["lefts"])
                rights.append([b.decode() for _, b in path] + head["rights"])
            yield pa.RecordBatch.from_arrays(
                [rows.column("tree").combine_chunks(), rows.column("pos").combine_chunks(),
                 rows.column("node").combine_chunks(), pa.array(lefts, pa.list_(pa.string())),
                 pa.array(rights, pa.list_(pa.string())), pa.array([head["subroot"]] * len(nodes), pa.string())],
                names=["tree", "pos", "node", "lefts", "rights", "subroot"])
    return run


def _with_headers(nodes: DataFrame, paths: DataFrame, arity: int, levels: int, n_rows: int) -> DataFrame:
    """Nodes of a round and, before each chunk of them, the path of the node above the chunk."""
    heads = paths.select("tree", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"),
                         "lefts", "rights", "subroot")
    return _by_chunk(nodes.unionByName(heads, allowMissingColumns=True), arity, levels, n_rows)


def _paths(rounds: list[DataFrame], top: DataFrame, arity: int, levels: int, n_rows: int) -> DataFrame:
    """``top(tree, pos, lefts, rights, subroot)`` of the last round -> the paths of the nodes of the first."""
    paths = top
    for nodes in reversed(rounds[:-1]):
        rows = _with_headers(nodes.select("tree", "pos", "n", "node"), paths, arity, levels, n_rows)
        paths = save(rows.mapInArrow(_down(arity, levels), f"tree string, pos long, node string, {_PATH}"),
                     "merkle-paths")
    return paths


def _fold(arity: int, levels: int, root: str):
    def run(batches):
        for t in _runs(batches):
            head, rows = t.slice(0, 1).to_pylist()[0], t.slice(1)
            leaves = [x.encode() for x in rows.column("node").to_pylist()]
            chunk = Chunk(leaves, levels_of(rows.column("n")[0].as_py(), arity, levels), arity)
            above = []  # retained once for the chunk: the state after the left siblings, and the right ones
            for left, right in zip(head["lefts"], head["rights"]):
                above.append((hashlib.sha256(left.encode()), right.encode()))
            upper = "".join(x for pair in zip(head["lefts"], head["rights"]) for x in pair).encode()
            proofs, folded = [], []
            for i, (leaf, other) in enumerate(zip(leaves, rows.column("altered").to_pylist())):
                proof = hashlib.sha256(b"".join(x for pair in chunk.siblings(i) for x in pair))
                proof.update(upper)
                proofs.append(proof.hexdigest())
                node = chunk.fold(i, leaf if other is None else other.encode())
                for state, right in above:
                    state = state.copy()
                    state.update(node)
                    state.update(right)
                    node = state.hexdigest().encode()
                folded.append(node.decode())
            n = len(leaves)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").combine_chunks(), rows.column("node").combine_chunks(),
                 pa.array([head["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()),
                 pa.array(proofs, pa.string()), pa.array(folded, pa.string()),
                 pa.array([x == root for x in folded], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


_PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def _positions(rows: DataFrame, tree: str, order: list[str], n_rows: int) -> DataFrame:
    """Saved ``rows`` with ``pos``, their place in their tree by ``order`` (total), and ``n``, the tree's rows.

    Range partitioning and a sort, then counts per tree and partition: no tree needs to fit one task.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n_rows // ROWS_PER_TASK + 1)
    keys = [F.col(tree), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = save(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                 .withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
                 "merkle-order")
    per = dealt.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(tree)
    before = per.select(tree, "part", F.sum("c").over(whole).alias("n"),
                        (F.sum("c").over(whole.orderBy("part")) - F.col("c") - F.col("first")).alias("shift"))
    return dealt.join(before, [tree, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def prove(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
          source_col: str = "source", text_col: str = "text", arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Manifest and proof of every row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``altered``: the text that stands in for ``text_col`` when a row is folded (none or null: its own), so
    ``verified`` tells whether what is there now is what the manifest was made from.
    """
    own = {f: F.col(f) for f in fields}
    leaf = digest(own)
    used = F.lit(None).cast("string")
    if altered is not None:
        now = altered.cast("string")
        changed = now.isNotNull() & ~now.eqNullSafe(F.col(text_col))
        used = F.when(changed, digest({**own, text_col: F.when(changed, now)}))
    # a source's tree by a key that is never null and sorts as sources do, null first
    leaves = save(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                              F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("tree"),
                              leaf.alias("node"), used.alias("altered"), F.monotonically_increasing_id().alias("row")),
                  "merkle-leaves")
    sizes = leaves.groupBy("tree").count().agg(F.max("count").alias("most"), F.sum("count").alias("n"),
                                               F.count(F.lit(1)).alias("trees")).first()
    if not sizes["n"]:
        return docs.sparkSession.createDataFrame([], _PROVED)
    leaves = save(_positions(leaves, "tree", ["doc_id", "node", "row"], sizes["n"]), "merkle-leaves-in-order")
    rounds = _build(leaves, sizes["most"], sizes["trees"], sizes["n"], arity, levels)
    # the sources' own tree
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    subroots = save(_positions(subroots, "tree", ["source"], sizes["trees"]), "merkle-subroots")
    upper = _build(subroots, sizes["trees"], 1, sizes["trees"], arity, levels)
    root = upper[-1].first()["node"]
    spark = docs.sparkSession
    none = spark.createDataFrame([("", 0, [], [], None)], f"tree string, pos long, {_PATH}")
    tops = _paths(upper, none, arity, levels, sizes["trees"])
    tops = tops.join(subroots.select("pos", "source", F.col("node").alias("top")), "pos").select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights",
        F.col("top").alias("subroot"))
    if len(rounds) > 1:
        tops = _paths(rounds[1:], tops, arity, levels, sizes["n"] // arity**levels + sizes["trees"])
    rows = _with_headers(leaves.select("tree", "pos", "n", "node", "altered", "doc_id"),
                         tops.select("tree", "pos", "lefts", "rights", "subroot"), arity, levels, sizes["n"])
    return rows.mapInArrow(_fold(arity, levels, root), _PROVED)
