"""Merkle manifest of a dataset: supersteps on RDDs pass digests up to a root and sibling paths down to the leaves.

Rows are leaves; the leaves of one tree (a source) ascend by id, runs of three
become a parent, and the trees' roots are the leaves of one more tree. Digests
are SHA-256 in lowercase hex; a parent is the digest of its children's hex text.

A vertex is a block of 729 neighbouring nodes, six levels of runs, so that a
superstep's messages are one for every 729 nodes and trees of 10^11 leaves take
four supersteps up and four down. Going up, blocks message their digest to the
block that holds their parent; a parent is complete when all the children that
the tree's size tells have come, hashes its levels and forwards. Going down, a
block tells each child its siblings and the path from the block to the root; the
last superstep expands paths leaf by leaf, so only blocks' paths travel, never
leaves'. Blocks of one tree have keys of their own: a source with a third of all
rows is spread like any other.

Texts are hashed once, in the JVM, and not shuffled. Leaves are dealt by range of
(tree, id, leaf, row), which also splits a hot id. Their places come from counts
for each range and tree. What reaches the driver is the number of leaves of the
largest tree and the root.

Defined cases: a null value hashes as ``-``; a null tree comes first; a null id
comes first and is never tampered with; repeated rows are leaves each, of equal
digest, in any order; ids that repeat with different rows ascend by leaf; an
empty table gives no rows; further columns take no part unless they are named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

RUN, LEVELS = 3, 6
BLOCK = RUN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "id string, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def leaf_digest(values: list[Column]) -> Column:
    """Hex SHA-256 of values, each as its length in bytes, a colon and itself, or ``-`` if null."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def leaves(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source", key: str = "doc_id", changed: dict[str, Column] | None = None) -> DataFrame:
    """(tree, id, leaf, found): the digest of each row's named columns, and that of the row with the columns ``changed`` replaced."""
    own = leaf_digest([F.col(c) for c in columns])
    found = leaf_digest([(changed or {}).get(c, F.col(c)) for c in columns])
    return documents.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("id"), own.alias("leaf"), found.alias("found"))


def rounds_of(count: int) -> int:
    """Levels of runs above ``count`` nodes of one tree, as many as a block has at most."""
    n = 0
    while count > 1 and n < LEVELS:
        count, n = -(-count // RUN), n + 1
    return n


def levels_of(nodes: list[bytes], rounds: int) -> list[list[bytes]]:
    out = [nodes]
    for _ in range(rounds):
        out.append([digest(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def siblings(levels: list[list[bytes]], at: int) -> list[tuple[int, list[bytes]]]:
    """For each level below the block's own digest: the place in the run, and the run's others."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % RUN
        run = nodes[first : first + RUN]
        out.append((at - first, run[: at - first] + run[at - first + 1 :]))
        at //= RUN
    return out


def fold(node: bytes, path: list[tuple[int, list[bytes]]]) -> bytes:
    """What a node and its siblings, level by level, come to."""
    for place, others in path:
        node = digest([*others[:place], node, *others[place:]])
    return node


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring leaves of one tree, a block's worth at most: range, tree, place of the first in range and tree, ids, digests."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    ids: list[str | None] = []
    own: list[bytes] = []
    seen: list[bytes] = []
    tree, at = None, 0

    def flush() -> pa.RecordBatch:
        values = [part, tree, at, ids, b"".join(own), b"".join(seen)]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "tree", "at", "ids", "leaves", "found"])

    for batch in batches:
        for t, i, leaf, found in zip(*(batch.column(c).to_pylist() for c in ("tree", "id", "leaf", "found")), strict=True):
            if ids and (t != tree or len(ids) == BLOCK):
                yield flush()
                at = at + len(ids) if t == tree else 0
                ids, own, seen = [], [], []
            tree = t
            ids.append(i)
            own.append(bytes.fromhex(leaf))
            seen.append(bytes.fromhex(found))
    if ids:
        yield flush()


def _split(row) -> Iterator[tuple]:
    """((tree, block), (slot, leaves of the tree, ids, digests, digests found)) of a fragment; it may reach into a second block."""
    n, start, i = len(row.ids), row.at + row.before, 0
    while i < n:
        block, slot = divmod(start + i, BLOCK)
        j = min(n, i + BLOCK - slot)
        yield (row.tree, block), (slot, row.total, row.ids[i:j], bytes(row.leaves[32 * i : 32 * j]), bytes(row.found[32 * i : 32 * j]))
        i = j


def _gathered(parts) -> tuple:
    """(leaves of the tree, ids, digests, digests found) of a block from its fragments."""
    parts = sorted(parts, key=lambda p: p[0])
    return parts[0][1], [i for p in parts for i in p[2]], b"".join(p[3] for p in parts), b"".join(p[4] for p in parts)


def _nodes(joined: bytes) -> list[bytes]:
    return [joined[i : i + 32] for i in range(0, len(joined), 32)]


def _own(vertex: tuple) -> bytes:
    """A block's digest: a vertex is (nodes of the tree at this height, digests)."""
    count, joined = vertex
    return levels_of(_nodes(joined), rounds_of(count))[-1][0]


def _complete(item: tuple) -> tuple:
    """A parent block once every child has sent its digest."""
    (tree, block), messages = item
    children = sorted(messages)
    count = children[0][1]
    if [c[0] for c in children] != list(range(min(BLOCK, count - block * BLOCK))):
        raise ValueError(f"block {block} of {tree!r} lacks children")
    return (tree, block), (count, b"".join(c[2] for c in children))


class Forest:
    """Trees over leaves (tree, id, leaf, found): vertices of every superstep, and the trees' roots."""

    def __init__(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.asc_nulls_first("tree"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("row")]
        dealt = stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves").repartitionByRange(parts, *order).sortWithinPartitions(*order)
        kinds = "part int, tree string, at long, ids array<string>, leaves binary, found binary"
        pieces = stored(dealt.select("tree", F.col("id").cast("string").alias("id"), "leaf", "found").mapInArrow(_fragments, kinds), "fragments")
        # a row for each range and tree: a tree has as many as there are ranges at most
        held = pieces.groupBy("part", "tree").agg(F.sum(F.size("ids")).alias("n"))
        before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
        places = held.select(F.col("part").alias("p"), F.col("tree").alias("t"), before.alias("before"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
        most, every = (x or 0 for x in held.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.max("n"), F.sum("n")).first())
        parts = min(parts, every // (8 * BLOCK) + 1)
        placed = pieces.join(places, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t"))).drop("p", "t")
        self.blocks: RDD = placed.rdd.flatMap(_split).groupByKey(parts).mapValues(_gathered)
        self.ups: list[RDD] = [self.blocks.mapValues(lambda b: (b[0], b[2]))]
        while most > BLOCK:
            most, parts = -(-most // BLOCK), parts // BLOCK + 1
            tell = self.ups[-1].filter(lambda v: v[1][0] > BLOCK)
            tell = tell.map(lambda v: ((v[0][0], v[0][1] // BLOCK), (v[0][1] % BLOCK, -(-v[1][0] // BLOCK), _own(v[1]))))
            self.ups.append(tell.groupByKey(parts).map(_complete, preservesPartitioning=True))

    def roots(self) -> RDD:
        """(tree, its root)."""
        tops = [up.filter(lambda v: v[1][0] <= BLOCK).map(lambda v: (v[0][0], _own(v[1]))) for up in self.ups]
        return tops[0].context.union(tops)

    def paths(self, above: RDD) -> RDD:
        """((tree, block), (block of leaves, (what ``above`` has of the tree, path from the block to the tree's root and on)))."""
        inherited = above.map(lambda x: ((x[0], 0), x[1]))
        told = None
        for up in reversed(self.ups):
            parts = up.getNumPartitions()
            came = up.filter(lambda v: v[1][0] <= BLOCK).join(inherited, parts)
            if told is not None:
                came = came.union(up.filter(lambda v: v[1][0] > BLOCK).join(told, parts))
            told = came if up is self.ups[0] else came.flatMap(_tell)
        return self.blocks.join(told.mapValues(lambda v: v[1]), self.blocks.getNumPartitions())


def _tell(item: tuple) -> Iterator[tuple]:
    """A block's message to each child: the child's siblings in the block, then the block's own path."""
    (tree, block), ((count, joined), (head, path)) = item
    levels = levels_of(_nodes(joined), rounds_of(count))
    for slot in range(len(levels[0])):
        yield (tree, block * BLOCK + slot), (head, siblings(levels, slot) + path)


def _expand(item: tuple) -> Iterator[tuple]:
    """(id, tree, digest, digest found, head, path) of each leaf of a block."""
    (tree, _), ((count, ids, own, found), (head, path)) = item
    levels = levels_of(_nodes(own), rounds_of(count))
    for at, (key, leaf, seen) in enumerate(zip(ids, levels[0], _nodes(found), strict=True)):
        yield key, tree, leaf, seen, head, siblings(levels, at) + path


def _proof(item: tuple) -> tuple:
    key, tree, leaf, found, (subroot, root), path = item
    proof = digest([x for _, others in path for x in others])
    folded = fold(found, path)
    return key, tree, leaf.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root


def proofs(rows: DataFrame) -> DataFrame:
    """Of ``leaves``: id (as text), tree, leaf, subroot, root, digest of the siblings up to the root, what the digest found folds to with them, and whether that is the root."""
    spark = rows.sparkSession
    forest = Forest(rows)
    subroots = forest.roots().map(lambda x: (x[0], x[1].hex()))
    trees = stored(spark.createDataFrame(subroots, "tree string, leaf string"), "subroots")
    top = Forest(trees.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "leaf", F.col("leaf").alias("found")))
    root = [x[1] for x in top.roots().take(1)]
    if not root:
        return spark.createDataFrame([], PROOF)
    whole = spark.sparkContext.parallelize([("", ("", []))], 1)
    above = top.paths(whole).flatMap(_expand).map(lambda x, root=root[0]: (x[0], ((x[2], root), x[5])))
    return spark.createDataFrame(forest.paths(above).flatMap(_expand).map(_proof), PROOF, verifySchema=False)


def tampered(key: str = "doc_id", text: str = "text") -> Column:
    """The text without line breaks in rows whose crc32(id as text) is even."""
    even = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(even, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))
