"""Operator 11: Merkle dataset manifest as a postorder append log.

Each row is a leaf: the SHA-256 of its fields, every field written as byte count, ``:`` and value, or ``-`` for null. The
leaves of one tree (here: one language) ascend by key; every two consecutive nodes of a level become their digest, the
last of an odd level alone, until one node is left. The trees' roots, in order, are the leaves of the last tree.

Aligned builders: a block of 2^BLOCK_BITS consecutive leaves, aligned to that size, is one builder. It appends its nodes
to the log in the order in which they are complete, which is their postorder, and its last node is a leaf for the
builders one tier up; a tier has 2^BLOCK_BITS times fewer leaves, so a tree of 10^11 rows has four tiers. Nothing in the
log holds a pointer: the postorder place of a node follows in closed form from the sizes of the subtrees before it
(``place``), which is how proofs find their siblings, in the segment of one builder (``Segment``) or in the
log of a whole tree.

Proofs go down the tiers: a builder's row is joined with the proof of its own root (one row for each builder) and gives
the proofs of its leaves, so no leaf ever fetches its siblings one by one over the network.

Scale: texts are read once, what is shuffled is about 150 bytes a row. Leaves are numbered by a range partition over
(tree, key), counts per partition and a running sum over partitions, so a tree with most of the rows is spread like any
other. A builder's row holds at most 2^BLOCK_BITS leaves. Every tier is written to the shared folder.

Edge cases: null fields are ``-`` and differ from empty ones; a null tree key is a tree of its own, before all others;
null ids come first; rows with equal ids are ordered by their leaf, so equal rows are interchangeable and each keeps its
result row; a tree of one row is its leaf, and its proof has only what stands above; an empty table has no rows and no
root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, stream

#: A builder appends the nodes over 2^BLOCK_BITS consecutive leaves.
BLOCK_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

SEGMENT = "tree string, block long, leaves long, height int, log array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def leaf_digest(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")),
                          F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def place(leaves: int, height: int, index: int) -> int:
    """Postorder place of node ``index`` of level ``height`` in a tree over ``leaves`` leaves.

    A node over 2^height leaves comes after the 2i - popcount(i) nodes that are complete before its last leaf i, and after
    its own ``height`` levels of last descendants. Nodes over fewer leaves, one a level at most and the lowest just
    above the lowest set bit of ``leaves``, come after all complete ones, in order of height.
    """
    last = ((index + 1) << height) - 1
    if last < leaves:
        return 2 * last - last.bit_count() + height
    lowest = (leaves & -leaves).bit_length() - 1
    return 2 * leaves - leaves.bit_count() + height - lowest - 1


def append_nodes(leaves: list[str], height: int) -> list[str]:
    """The nodes over ``leaves`` up to ``height``, in the order in which they are complete; the last is the root."""
    log: list[str] = []
    open_nodes: dict[int, str] = {}  # complete nodes that wait for the next one of their level
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        while level < height and (i >> level) & 1:
            node = digest(open_nodes.pop(level), node)
            log.append(node)
            level += 1
        open_nodes[level] = node
    edge = None  # the node of the level that covers fewer leaves than its level's others
    for level in range(height):
        waiting = open_nodes.get(level)
        if waiting is None and edge is None:
            continue
        edge = digest(waiting or "", edge or "")
        log.append(edge)
    return log


class Segment:
    """The nodes that one builder appended, addressed by level and index."""

    def __init__(self, leaves: int, height: int, log: list[str]):
        self.leaves, self.height, self.log = leaves, height, log

    def node(self, level: int, index: int) -> str:
        return self.log[place(self.leaves, level, index)]

    def proof(self, leaf: int) -> list[str]:
        """Level by level up to the segment's root: ``<`` or ``>`` (left or right) and the sibling, empty if none."""
        steps = []
        for level in range(self.height):
            index = leaf >> level
            other = index ^ 1
            there = (other << level) < self.leaves
            steps.append(("<" if other < index else ">") + self.node(level, other) if there else "")
        return steps


def siblings_digest(proof: list[str]) -> str:
    return digest(*(step[1:] for step in proof))


def fold(leaf: str, proof: list[str]) -> str:
    """The root that follows from a leaf and its proof."""
    node = leaf
    for step in proof:
        node = digest(step[1:], node) if step[:1] == "<" else digest(node, step[1:])
    return node


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``df`` with ``idx``, each row's place within its tree in the order of ``order``, and ``n``, the tree's rows.

    The rows are range-partitioned over (tree, order) and written; a row's place is its distance from the partition's
    first row of its tree plus the counts of that tree in earlier partitions. A partition holds few rows of a tree that
    is spread over many, so no task sees a whole tree.
    """
    spread = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    rows = materialise(spread.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(tree, "_part", "_first", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"),
                           F.sum("_count").over(whole).alias("n"))
    return (rows.join(places, [tree, "_part"])
            .withColumn("idx", F.col("_row") - F.col("_first") + F.col("_before"))
            .drop("_row", "_part", "_first", "_before"))


def levels(leaves: Column) -> Column:
    """ceil(log2(leaves)): the levels above the leaves of a tree."""
    return F.when(leaves <= 1, 0).otherwise(F.length(F.bin(leaves - 1)))


def build_tier(leaves: DataFrame, extra: str = "") -> DataFrame:
    """One row for each builder over ``leaves`` (tree, idx, n, node): its log, and its leaves' ``extra`` columns in order.

    ``height`` is BLOCK_BITS, or what is left to the root where the tree has one builder.
    """
    more = [c.split()[0] for c in extra.split(",")] if extra else []
    block = F.shiftright("idx", BLOCK_BITS)
    rows = leaves.groupBy("tree", block.alias("block"), "n").agg(
        F.array_sort(F.collect_list(F.struct("idx", "node", *more))).alias("rows"))
    one = F.col("n") <= (1 << BLOCK_BITS)
    rows = rows.select("tree", "block", F.when(one, levels(F.col("n"))).otherwise(BLOCK_BITS).alias("height"),
                       F.col("rows.node").alias("nodes"), *[F.col("rows").getField(c).alias(c) for c in more])

    def build(batches: Iterator[tuple]) -> Iterator[tuple]:
        for columns in batches:
            for tree, block, height, nodes, *kept in zip(*columns):
                yield tree, block, len(nodes), height, append_nodes(nodes, height), *kept

    schema = SEGMENT + "".join(f", {c.strip().split()[0]} array<{c.strip().split()[1]}>" for c in extra.split(",") if c)
    return materialise(stream(rows, schema, build, per_batch=64), "merkle-log")


def build_log(leaves: DataFrame, extra: str = "") -> list[DataFrame]:
    """The tiers of builders over ``leaves`` (tree, idx, n, node), lowest first, each written in the shared folder.

    The number of tiers follows from the largest tree's number of rows.
    """
    tiers = [build_tier(leaves, extra)]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > (1 << BLOCK_BITS):
        below = tiers[-1]
        count = Window.partitionBy("tree")
        # one row for each builder of the tier below: 2^BLOCK_BITS times fewer than its leaves
        counts = below.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
        roots = below.select("tree", F.col("block").alias("idx"), F.element_at("log", -1).alias("node"))
        tiers.append(build_tier(roots.join(counts.filter("n > 1"), "tree")))
        most = -(-most >> BLOCK_BITS)
    return tiers


def tree_roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, root): the last node of the builder that covers its whole tree."""
    roots = None
    for tier in tiers:
        last = tier.groupBy("tree").agg(F.count(F.lit(1)).alias("builders"),
                                        F.max(F.element_at("log", -1)).alias("root"))
        last = last.filter("builders = 1").select("tree", "root")
        roots = last if roots is None else roots.unionByName(last)
    return roots


def leaf_proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier's rows with ``proof``: the steps from the builder's root to the root of all, and ``about``.

    ``above`` has a row for each tree: the steps that stand above it, and what else its leaves shall know (``about``).
    """
    kind = above.schema["about"].dataType.simpleString()
    whole = above.select("tree", F.lit(0).cast("long").alias("block"), "steps", "about")
    known = whole
    for tier in reversed(tiers[1:]):
        def down(batches: Iterator[tuple]) -> Iterator[tuple]:
            for columns in batches:
                for tree, block, leaves, height, log, rest, about in zip(*columns):
                    segment = Segment(leaves, height, log)
                    for k in range(leaves):
                        yield tree, (block << BLOCK_BITS) + k, segment.proof(k) + rest, about

        rows = tier.join(known, ["tree", "block"]).select("tree", "block", "leaves", "height", "log", "steps", "about")
        steps = materialise(stream(rows, f"tree string, block long, steps array<string>, about {kind}", down,
                                   per_batch=1024), "merkle-proofs")
        # a tree that ends below takes what stands above it, the others this tier's proofs
        known = steps.unionByName(whole.join(steps.select("tree").distinct(), "tree", "left_anti"))
    return tiers[0].join(known, ["tree", "block"]).withColumnRenamed("steps", "proof")


def tree_name(key: Column) -> Column:
    """A tree's key as text that sorts null first, then by UTF-8 bytes."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key.cast("string")))


def manifest(docs: DataFrame, tree: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             forged: dict[str, Column] | None = None, forge: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, idx, position, proof.

    ``proof`` has the steps to the root (see ``Segment.proof``), ``idx`` the leaf's place in its tree and ``position`` that
    in the tree's postorder log. ``forged`` gives other values for some fields where ``forge`` is true: folded_root is
    computed from the leaf that they give and the original siblings, so verified shows whether a proof exposes them.
    """
    prepare(docs.sparkSession)
    leaf = leaf_digest(*[F.col(f) for f in fields])
    if forge is None:
        presented = F.lit(None).cast("string")
    else:
        presented = F.when(forge, leaf_digest(*[(forged or {}).get(f, F.col(f)) for f in fields]))
    leaves = materialise(docs.select(tree_name(F.col(tree)).alias("tree"), F.col(id_col).cast("long").alias("id"),
                                     leaf.alias("node"), presented.alias("presented")), "merkle-leaves")
    tiers = build_log(numbered(leaves, "tree", ["id", "node"]), "id long, presented string")
    sizes = tiers[0].groupBy("tree").agg(F.sum("leaves").alias("size"))
    roots = tree_roots(tiers).join(sizes, "tree").select(F.lit("").alias("all"), "tree", F.col("root").alias("node"), "size")
    forest = numbered(roots, "all", ["tree"]).select(F.col("all").alias("tree"), "idx", "n", "node",
                                                     F.col("tree").alias("name"), "size")
    none_above = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<string>").alias("steps"),
                                                   F.lit(0).alias("about"))

    def of_trees(batches: Iterator[tuple]) -> Iterator[tuple]:
        for columns in batches:
            for leaves_, height, log, names, sizes_, rest in zip(*columns):
                segment = Segment(leaves_, height, log)
                for k, (name, size) in enumerate(zip(names, sizes_)):
                    subroot, steps = segment.node(0, k), segment.proof(k) + rest
                    yield name, steps, {"subroot": subroot, "root": fold(subroot, steps), "n": size}

    top = leaf_proofs(build_log(forest, "name string, size long"), none_above)
    above = materialise(stream(top.select("leaves", "height", "log", "name", "size", "proof"),
                               "tree string, steps array<string>, about struct<subroot: string, root: string, n: bigint>",
                               of_trees), "merkle-trees")

    def of_leaves(batches: Iterator[tuple]) -> Iterator[tuple]:
        for columns in batches:
            for block, leaves_, height, log, ids, others, rest, about in zip(*columns):
                segment, root = Segment(leaves_, height, log), about["root"]
                for k, (id_, other) in enumerate(zip(ids, others)):
                    idx, steps, own = (block << BLOCK_BITS) + k, segment.proof(k) + rest, segment.node(0, k)
                    folded = fold(other or own, steps)
                    yield (id_, own, about["subroot"], root, siblings_digest(steps), folded, folded == root, idx,
                           place(about["n"], 0, idx), steps)

    rows = leaf_proofs(tiers, above).select("block", "leaves", "height", "log", "id", "presented", "proof", "about")
    return stream(rows, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                  "folded_root string, verified boolean, idx long, position long, proof array<string>", of_leaves,
                  per_batch=2048)
