"""A Merkle manifest of a table, by time-forward processing over node labels.

Every row is a leaf, every group of rows (a language) a tree, and the trees' roots are the leaves of one
more tree. Where several nodes remain, each ``FAN`` consecutive ones become their parent.

Nodes are labelled by tree, level and place. A node sends its digest to its parent's label, and a priority
queue ordered by label delivers the digests in the order in which parents are worked off. The external part
of that queue is Spark's sorted shuffle: one round brings the messages of a block of ``FAN ** LEVELS``
neighbouring labels to one task in label order, which works the block's inner labels off with a heap of its
own and sends one message on. A reversed sweep runs the rounds backwards: each block receives the proof of its
topmost node, its nodes are visited by falling label, and every one hands its proof on to its children with
their siblings in front, until the leaves have theirs. A task holds one block at a time, whatever the size of
a tree; a round is a stored table, so a lost executor costs a re-read.

Trees and leaves ascend, null first; leaves with equal order values ascend by digest, and rows that are
equal in all columns have the same digest, so which is which does not matter. Null columns are part of the
digest, texts of any length are hashed whole, an empty table has an empty manifest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from airstats.storage import stored

#: Nodes below one parent, and levels of a tree that one round works off.
FAN, LEVELS = 8, 4

PROOF = "array<struct<at:int,others:string>>"
_STEPS = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))


def row_digest(*cols: Column) -> Column:
    """sha256 (lowercase hex) of the columns: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    texts = [c.cast("string") for c in cols]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    ).cast("binary"), 256)


def proof_root(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def parent(digest: Column, step: Column) -> Column:
        before = F.substr(step["others"], F.lit(1), step["at"] * 64)
        after = F.substr(step["others"], step["at"] * 64 + 1, F.length(step["others"]))
        return F.sha2(F.concat(before, digest, after).cast("binary"), 256)

    return F.aggregate(proof, leaf, parent)


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: step["others"]), "")


# Places of rows.

def _placed(rows: DataFrame, order: Sequence[str], tree: str) -> DataFrame:
    """``rows`` with their place ``idx`` in their tree and its size ``n``.

    A range shuffle puts the rows in order over all tasks, without regard to trees, so a large tree lies in
    many tasks; rows of equal order values are told apart by an arbitrary number and may part, too.
    """
    numbered = rows.withColumn("_any", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*order, "_any").sortWithinPartitions(*order, "_any").drop("_any")
    ranged = stored(ranged.withColumn("_seq", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("_seq", 33)
    # A row per task and tree in it; tasks hold ranges, so this has hardly more rows than there are tasks and trees.
    runs = ranged.groupBy(part.alias("_part"), F.col(tree).alias("_tree")).agg(
        F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    of_tree = Window.partitionBy("_tree")
    runs = stored(runs.withColumns({
        "_before": F.sum("_rows").over(of_tree.orderBy("_part")) - F.col("_rows"),
        "n": F.sum("_rows").over(of_tree)}).drop("_rows"), "merkle-runs")
    return ranged.join(runs, (part == F.col("_part")) & F.col(tree).eqNullSafe(F.col("_tree"))).withColumn(
        "idx", F.col("_before") + F.col("_seq") - F.col("_first")).drop("_part", "_tree", "_first", "_before", "_seq")


# Work within a block.

def _levels(n: int, most: int) -> int:
    """Levels above a block's nodes, of which its tree has ``n`` in all."""
    if n > FAN ** most:
        return most
    above = 0
    while n > 1:
        n, above = -(-n // FAN), above + 1
    return above


class _Node(NamedTuple):
    label: tuple[int, int]
    children: list[int]
    digests: list[str]


def _forward(first: int, n: int, digests: list[str], levels: int) -> tuple[str, list[_Node]]:
    """The topmost digest of a block and the inner nodes in the order of their labels."""
    top, done = _levels(n, levels), []
    if not top:
        return digests[0], done
    queue = [((1, (first + i) // FAN), first + i, digest) for i, digest in enumerate(digests)]
    heapq.heapify(queue)
    while True:
        label, children, below = queue[0][0], [], []
        while queue and queue[0][0] == label:
            _, child, digest = heapq.heappop(queue)
            children.append(child)
            below.append(digest)
        own = hashlib.sha256("".join(below).encode()).hexdigest()
        done.append(_Node(label, children, below))
        if label[0] == top:
            return own, done
        heapq.heappush(queue, ((label[0] + 1, label[1] // FAN), label[1], own))


def _backward(first: int, count: int, nodes: list[_Node], above: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Proofs of a block's nodes, from that of its topmost."""
    proofs = {nodes[-1].label if nodes else (0, first): above}
    for label, children, digests in reversed(nodes):
        own = proofs.pop(label)
        for at, child in enumerate(children):
            others = "".join(digests[:at] + digests[at + 1:])
            proofs[label[0] - 1, child] = [(at, others), *own]
    return [proofs[0, first + i] for i in range(count)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one tree and block each, from batches in which they follow each other."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        trees, blocks = (table.column(c).combine_chunks() for c in ("tree", "block"))
        changes = pc.or_(pc.not_equal(trees[1:], trees[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        bounds = [0, *(i + 1 for i in pc.indices_nonzero(changes).to_pylist())]
        for low, high in zip(bounds, bounds[1:]):
            yield table.slice(low, high - low)
        rest = table.slice(bounds[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _dealt(nodes: DataFrame) -> DataFrame:
    """Messages of a block side by side in one task, in the order of their labels."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _block(levels: int) -> Column:
    return F.shiftright("idx", levels * (FAN.bit_length() - 1))


def _raised(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` levels higher: tree, idx, n, digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        for block in _blocks(batches):
            n = block.column("n")[0].as_py()
            digest, _ = _forward(block.column("idx")[0].as_py(), n, block.column("digest").to_pylist(), levels)
            for values, value in zip(out, (block.column("tree")[0].as_py(), block.column("block")[0].as_py(),
                                           -(-n // FAN ** levels), digest)):
                values.append(value)
            if len(out[0]) == 1024:
                yield as_batch(out)
                out = [[], [], [], []]
        yield as_batch(out)

    def as_batch(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["tree", "idx", "n", "digest"])

    messages = nodes.select("tree", _block(levels).alias("block"), "idx", "n", "digest")
    return stored(_dealt(messages).mapInArrow(run, "tree long, idx long, n long, digest string"), "merkle-nodes")


def _lowered(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, idx, n, digest, kept) with ``proof`` and ``subroot`` from those of the nodes ``above``."""
    kept = nodes.schema["kept"].dataType
    names = ["tree", "idx", "kept", "subroot", "proof"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            # the message from above has place -1 and so comes first
            proof = [(s["at"], s["others"]) for s in block.column("proof")[0].as_py()]
            subroot = block.column("subroot")[0].as_py()
            own = block.slice(1).combine_chunks()
            first, count = own.column("idx")[0].as_py(), own.num_rows
            _, nodes = _forward(first, own.column("n")[0].as_py(), own.column("digest").to_pylist(), levels)
            proofs = _backward(first, count, nodes, proof)
            places = pa.array([0, *(len(p) for p in proofs)], pa.int32())
            flat = [step for p in proofs for step in p]
            steps = pa.StructArray.from_arrays(
                [pa.array([at for at, _ in flat], pa.int32()), pa.array([o for _, o in flat], pa.string())],
                fields=list(_STEPS.value_type))
            lists = pa.ListArray.from_arrays(pc.cumulative_sum(places), steps).cast(_STEPS)
            columns = [own.column(c).combine_chunks() for c in ("tree", "idx", "kept")]
            whole = pa.Table.from_arrays([*columns, pa.array([subroot] * count, pa.string()), lists], names=names)
            yield from whole.to_batches(max_chunksize=1024)

    none = F.lit(None)
    down = nodes.select("tree", _block(levels).alias("block"), "idx", "n", "digest", "kept",
                        none.cast("string").alias("subroot"), none.cast(PROOF).alias("proof"))
    messages = above.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"),
                            F.lit(0).cast("long").alias("n"), none.cast("string").alias("digest"),
                            none.cast(kept).alias("kept"), "subroot", "proof")
    return _dealt(down.unionByName(messages)).mapInArrow(
        run, f"tree long, idx long, kept {kept.simpleString()}, subroot string, proof {PROOF}")


class _Forest:
    """Rounds of nodes of a set of trees, from the leaves to the roots."""

    def __init__(self, leaves: DataFrame, levels: int):
        self.rounds, self.levels = [leaves], levels
        nodes = leaves.select("tree", "idx", "n", "digest")
        while not nodes.where("n > 1").isEmpty():
            nodes = _raised(nodes, levels)
            self.rounds.append(nodes)
        #: tree and digest of every root
        self.roots = nodes.select("tree", "digest")

    def proofs(self, of_roots: DataFrame) -> DataFrame:
        """Leaves with their proofs; ``of_roots`` has tree, subroot and proof of every root."""
        above = of_roots.withColumn("idx", F.lit(0).cast("long"))
        for nodes in reversed(self.rounds[1:-1]):
            above = stored(_lowered(nodes.withColumn("kept", F.lit(0)), above, self.levels), "merkle-proofs")
        if len(self.rounds) == 1:  # every leaf is a root
            return self.rounds[0].select("tree", "idx", "kept").join(above.drop("idx"), "tree")
        return _lowered(self.rounds[0], above, self.levels)


def manifest(docs: DataFrame, columns: Sequence[str], tree: str = "lang", order: str = "doc_id",
             carry: Callable[[DataFrame], dict[str, Column]] | None = None, levels: int = LEVELS) -> DataFrame:
    """For each row of ``docs``: ``order``, leaf, subroot, root and proof, an array with the place among its
    siblings and their digests one after the other (struct<at:int, others:string>) for every level from the
    leaf to the root.

    ``columns`` make up the leaf's digest. ``carry`` gives further columns of the row to be returned. A task
    holds ``FAN ** levels`` nodes at a time.
    """
    extra = carry(docs) if carry else {}
    leaves = stored(docs.select(
        F.col(tree).alias("tree_name"), F.col(order).alias("key"),
        row_digest(*[F.col(c) for c in columns]).alias("digest"),
        *[c.alias(f"extra_{name}") for name, c in extra.items()]), "merkle-leaves")
    names = leaves.select("tree_name").distinct().withColumn("_all", F.lit(0))
    trees = stored(_placed(names, ["tree_name"], "_all").withColumnsRenamed({"idx": "tree", "n": "trees"}), "merkle-trees")
    placed = _placed(leaves, ["tree_name", "key", "digest"], "tree_name").join(
        trees.select(F.col("tree_name").alias("_name"), "tree"), F.col("tree_name").eqNullSafe(F.col("_name")))
    kept = F.struct("key", F.col("digest").alias("leaf"), *[f"extra_{name}" for name in extra])
    forest = _Forest(stored(placed.select("tree", "idx", "n", "digest", kept.alias("kept")), "merkle-placed"), levels)

    ends = trees.select("tree", F.col("trees").alias("n")).join(forest.roots, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "n", "digest",
        F.struct(F.col("digest").alias("subroot")).alias("kept"))
    crown = _Forest(stored(ends, "merkle-crown"), levels)
    root = crown.roots.agg(F.max("digest")).scalar()
    start = crown.roots.select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(PROOF).alias("proof"))
    of_roots = stored(crown.proofs(start).select(
        F.col("idx").alias("tree"), F.col("kept.subroot").alias("subroot"), "proof"), "merkle-crown-proofs")
    return forest.proofs(of_roots).select(
        F.col("kept.key").alias(order), F.col("kept.leaf").alias("leaf"), "subroot", root.alias("root"), "proof",
        *[F.col(f"kept.extra_{name}").alias(name) for name in extra])
