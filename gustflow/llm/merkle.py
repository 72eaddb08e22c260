"""Merkle manifest of a document table with incremental witnesses.

Every row is a leaf; the leaves of a language, ascending by doc_id, form an
8-ary tree, and the languages' roots, ordered by language (null first), form
the tree of the data set.  Leaf hashes are built-in functions over the scan.
The leaves are ranked by a range partitioning (offset per written partition
plus place inside it), cut into aligned blocks of 512 consecutive leaves, and
each block is appended leaf by leaf to a ``Frontier``: one open run per level.
A node that joins an open run takes the run's earlier nodes into the witnesses
below it, and is itself added to the witnesses of every earlier node; a full
run becomes its parent's next append.  Blocks run in parallel; their roots are
appended in the same way to the tree above, whose witnesses then extend those
of the blocks.  A task holds one block (512 leaves with at most 7 digests
a level), and no leaf passes through the driver.

Nulls of any column hash as ``-``; an empty text as ``0:``.  Rows with equal
doc_id order by leaf hash; repeated rows are leaves of their own with equal
hashes, so their order makes no difference.  An empty table has no leaves and
no root: every table of its manifest is empty.  Columns besides the five of
``FIELDS`` are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gustflow.llm.common import bucket_of, written

ARITY = 8
#: Levels folded inside one task, and the leaves they span.
BLOCK_LEVELS = 3
BLOCK = ARITY ** BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(values: dict[str, Column]) -> Column:
    """sha256 of the row's fields, each ``-`` if null, else its byte count, a
    colon and its text."""
    parts = []
    for name in FIELDS:
        s = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, changed, row) for every row of ``docs``.  ``tree``
    names the language so that its byte order is null first; ``changed`` is
    the leaf of the row with its text's A-Z lower-cased where ``tampered``
    holds, else null; ``row`` tells repeated rows apart."""
    cols = {name: F.col(name) for name in FIELDS}
    lowered = leaf_hash(cols | {"text": F.translate("text", _UPPER, _LOWER)})
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, lowered)
    return docs.select(F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit("")).alias("tree"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(cols).alias("leaf"), changed.alias("changed"),
                       F.monotonically_increasing_id().alias("row"))


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``rank`` (0, 1, ... within ``tree`` by the columns ``by``)
    and ``size`` (rows of the tree).  One range shuffle; a large tree spans
    many partitions, and only a count per (partition, tree) is summed up.
    The ordered rows and these counts are written; ranks follow from them on reading."""
    placed = written(df.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by)
                     .withColumn("at", F.monotonically_increasing_id()), "merkle_order")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    spans = spans.select("tree", "part", "first", F.sum("n").over(tree).alias("size"),
                         (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("before"))
    spans = written(spans, "merkle_spans")
    return (placed.join(spans, ["tree", "part"])
            .withColumn("rank", F.col("before") + F.col("at") - F.col("first"))
            .drop("part", "at", "first", "before"))


def combine(nodes: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Witness:
    """A leaf's siblings so far, level by level from left to right, and for
    each level how many of them stand left of its own path and how many there are."""

    __slots__ = ("path", "marks")

    def __init__(self) -> None:
        self.path, self.marks = bytearray(), []


class Frontier:
    """Streaming append to an aligned subtree.  ``runs[l]`` holds the finished
    nodes of level l whose parent is still open, each with the witnesses of
    the leaves below it."""

    def __init__(self, levels: int, record: bool = True):
        self.runs: list[list[tuple[bytes, list[Witness]]]] = [[] for _ in range(levels)]
        self.root: tuple[bytes, list[Witness]] | None = None
        self.record = record

    def append(self, node: bytes) -> Witness:
        own = Witness()
        self._add(0, node, [own])
        return own

    def _add(self, level: int, node: bytes, below: list[Witness]) -> None:
        if level == len(self.runs):
            self.root = (node, below)
            return
        run = self.runs[level]
        if self.record:
            for _, earlier in run:  # a sibling is complete: extend the partial witnesses
                for w in earlier:
                    w.path += node
                    w.marks[-1][1] += 1
            left = b"".join(n for n, _ in run)
            for w in below:
                w.path += left
                w.marks.append([len(run), len(run)])
        run.append((node, below))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self._add(level + 1, combine(n for n, _ in run), [w for _, below in run for w in below])

    def finish(self) -> bytes:
        """Close what is open, lowest level first; the subtree's root."""
        for level, run in enumerate(self.runs):
            if run:
                self._close(level)
        return self.root[0]


def levels_in_block(size: int) -> int:
    """Levels to fold inside a block of a tree of ``size`` nodes: up to its
    root where the tree fits in the block, else all levels of a block."""
    levels = 0
    while levels < BLOCK_LEVELS and ARITY ** levels < size:
        levels += 1
    return levels


def fold(node: bytes, path: bytes, marks: Iterable[tuple[int, int]]) -> bytes:
    """The root that a node and its witness lead to."""
    at = 0
    for left, total in marks:
        mid, end = at + HEX * left, at + HEX * total
        node = combine((path[at:mid], node, path[mid:end]))
        at = end
    return node


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("rank")


def _climb(table: pa.Table) -> pa.Table:
    table = _in_order(table)
    size = table["size"][0].as_py()
    frontier = Frontier(levels_in_block(size), record=False)
    for node in table["node"].to_pylist():
        frontier.append(node.encode())
    return pa.table({"tree": table["tree"].slice(0, 1), "rank": pa.array([table["rank"][0].as_py() // BLOCK], pa.int64()),
                     "size": pa.array([-(-size // BLOCK)], pa.int64()), "node": [frontier.finish().decode()]})


def climb(nodes: DataFrame) -> DataFrame:
    """(tree, rank, size, node): the roots of the blocks of ``nodes``, which
    are the nodes of the next round."""
    return (nodes.select("tree", "rank", "size", "node", F.expr(f"rank div {BLOCK}").alias("block"))
            .groupBy("tree", "block").applyInArrow(_climb, "tree string, rank long, size long, node string"))


def rounds_up(nodes: DataFrame, first: DataFrame | None = None) -> list[DataFrame]:
    """``nodes``, their block roots, those roots' block roots ... up to one
    node a tree.  ``first``: block roots of ``nodes`` if already known."""
    rounds = [nodes]
    while (most := rounds[-1].agg(F.max("size")).first()[0]) is not None and most > 1:
        known, first = first, None
        rounds.append(written(climb(rounds[-1]) if known is None else known, "merkle_roots"))
    return rounds


def _witnesses(table: pa.Table, above: pa.Table) -> tuple[pa.Table, list[Witness], bytes, list]:
    table = _in_order(table)
    frontier = Frontier(levels_in_block(table["size"][0].as_py()))
    held = [frontier.append(node.encode()) for node in table["node"].to_pylist()]
    frontier.finish()
    marks = above["marks"][0].as_py()
    return table, held, above["path"][0].as_py().encode(), [(marks[i], marks[i + 1]) for i in range(0, len(marks), 2)]


def _extend(table: pa.Table, above: pa.Table) -> pa.Table:
    table, held, path, marks = _witnesses(table, above)
    return pa.table({"tree": table["tree"], "rank": table["rank"],
                     "path": [(bytes(w.path) + path).decode() for w in held],
                     "marks": pa.array([bytes(x for m in [*w.marks, *marks] for x in m) for w in held], pa.binary())})


def _by_block(nodes: DataFrame, above: DataFrame):
    return (nodes.withColumn("block", F.expr(f"rank div {BLOCK}")).groupBy("tree", "block")
            .cogroup(above.withColumnRenamed("rank", "block").groupBy("tree", "block")))


def extend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, rank, path, marks) of the nodes of ``rounds[0]``, from the
    witnesses ``above`` of the last round's nodes (one a tree, rank 0)."""
    for nodes in reversed(rounds):
        above = _by_block(nodes.select("tree", "rank", "size", "node"), above).applyInArrow(
            _extend, "tree string, rank long, path string, marks binary")
    return above


@dataclass
class Manifest:
    """``leaves``: (tree, doc_id, node, changed, row, rank, size); ``rounds``:
    block roots of each round above them; ``trees``: (tree, subroot);
    ``above``: the witness of every tree's root in the data set's root;
    ``root``: None for an empty table."""

    leaves: DataFrame
    rounds: list[DataFrame]
    trees: DataFrame
    above: DataFrame
    root: str | None


def _manifest(ranked_leaves: DataFrame, first: DataFrame | None = None) -> Manifest:
    rounds = rounds_up(ranked_leaves, first)
    trees = written(rounds[-1].select("tree", F.col("node").alias("subroot")), "merkle_trees")
    # the languages' roots are leaves of one more tree
    top = ranked(trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), "name")
    top = written(top, "merkle_top")
    over = rounds_up(top)
    root = over[-1].select("node").first()
    empty = over[-1].select("tree", "rank", F.lit("").alias("path"), F.lit(b"").alias("marks"))
    above = (extend(over, empty).join(top.select("rank", "name"), "rank")
             .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "path", "marks"))
    return Manifest(ranked_leaves, rounds[1:], trees, written(above, "merkle_above"), root and root["node"])


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    found = written(leaves(docs, tampered), "merkle_leaves").withColumnRenamed("leaf", "node")
    return _manifest(ranked(found, "doc_id", "node", "row"))


def append(old: Manifest, docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of the old rows and ``docs``, whose doc_ids must exceed
    every old one of their language.  Full blocks keep their roots; only the
    open last block of a language and what is new are folded again."""
    new = written(leaves(docs, tampered), "merkle_leaves").withColumnRenamed("leaf", "node")
    last = old.leaves.groupBy("tree").agg(F.max("doc_id").alias("last"), F.max("size").alias("old"))
    late = new.join(last, "tree").where("doc_id is null or doc_id <= last")
    if not late.isEmpty():
        raise ValueError("appended rows must have larger doc_ids than the manifest's rows of their language")
    sizes = (ranked(new, "doc_id", "node", "row").join(last.select("tree", "old"), "tree", "left")
             .withColumn("old", F.coalesce("old", F.lit(0))))
    new = sizes.withColumn("rank", F.col("rank") + F.col("old")).withColumn("size", F.col("size") + F.col("old")).drop("old")
    new = written(new, "merkle_new")
    grown = new.groupBy("tree").agg(F.max("size").alias("grown"))
    kept = (old.leaves.join(grown, "tree", "left").withColumn("size", F.coalesce("grown", "size")).drop("grown"))
    every = written(kept.unionByName(new), "merkle_ranked")
    # blocks that were full, or whose tree has not grown, keep their root
    before = (old.rounds[0] if old.rounds else climb(old.leaves)).select("tree", "rank", "node")
    state = last.join(grown, "tree", "left")
    done = (before.join(state, "tree").where(f"grown is null or (rank + 1) * {BLOCK} <= old")
            .withColumn("size", F.ceil(F.coalesce("grown", "old") / BLOCK)).select("tree", "rank", "size", "node"))
    open_blocks = every.withColumn("block", F.expr(f"rank div {BLOCK}")).join(
        done.select("tree", F.col("rank").alias("block")), ["tree", "block"], "left_anti").drop("block")
    return _manifest(every, climb(open_blocks).unionByName(done))


def _verify(table: pa.Table, above: pa.Table) -> pa.Table:
    table, held, path, marks = _witnesses(table, above)
    proofs, folded = [], []
    for w, node, changed in zip(held, table["node"].to_pylist(), table["changed"].to_pylist()):
        whole = bytes(w.path) + path
        proofs.append(combine([whole]).decode())
        folded.append(fold((changed or node).encode(), whole, [*w.marks, *marks]).decode())
    return pa.table({"tree": table["tree"], "doc_id": table["doc_id"], "leaf": table["node"], "proof_sha256": proofs, "folded_root": folded})


def witnesses(m: Manifest) -> DataFrame:
    """(tree, rank, path, marks): every leaf's whole witness."""
    return extend([m.leaves, *m.rounds], m.above)


def verify(m: Manifest) -> DataFrame:
    """One row per leaf: its hash, its roots, the hash of its witness, and
    the root recomputed from the changed leaf where there is one."""
    above = extend(m.rounds, m.above) if m.rounds else m.above
    out = _by_block(m.leaves.select("tree", "rank", "size", "node", "doc_id", "changed"), above).applyInArrow(
        _verify, "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string")
    return (out.join(m.trees, "tree").withColumn("root", F.lit(m.root).cast("string"))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def checked(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` checked against rows of which those whose
    crc32(doc_id) is divisible by 3 were tampered with (null doc_ids were not)."""
    return verify(build(docs, bucket_of(F.col("doc_id"), 3) == 0))
