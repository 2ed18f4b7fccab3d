"""Operator 5: n-gram Jaccard join with a count-vector R-tree.

A text is the set of its distinct runs of five words (64-bit hashes); two texts link when their sets' Jaccard
similarity is at least PERCENT / 100. Tokens (shingles) hash into groups and a text is the point of its group counts;
the overlap of two texts is at most the sum of the coordinate minima of their points, and that of two tree nodes at
most the sum of the minima of their upper corners.

How it is spread:

1. Texts with equal sets form a class; all later work is on classes.
2. *Routing.* Over 2^64 groups the points are sparse, and two linked texts share a group among the rarest
   ``n - ceil(0.8 n) + 1`` of each; a class goes to the subtree of each of those groups. "Rare" is by counts of 2^20
   coarse groups over all texts, so a passage that many texts share routes hardly any of them. Groups that a single
   class goes to are dropped by a pre-aggregated count.
3. *Stars.* Classes that agree in one of SKETCHES min-hashes are compared with the most central class among them.
   These links are verified and contracted first: a large family of copies becomes one component and its subtrees
   are dropped, instead of holding all pairs of the family.
4. *Crowds.* A family of edited copies without a common centre leaves groups that hold many components. Each class of
   such a crowd goes to its largest group; the group's tree proposes at most two spanning forests: every class with
   the hub (a class that most others may link to) that bounds best, and with its best partner of all. Proposals are
   verified and contracted, and this is repeated as long as it links a fair part of the crowd.
5. *Trees.* What remains of a group is an R-tree over dense points of DIMENSIONS group counts. It is searched against
   itself; nodes of one component, of incompatible sizes or whose bound is too small are passed over. A group of
   over CHUNK classes is dealt to pairs of chunks, each a tree of its own.
6. Surviving pairs are verified on their exact sets, and links are contracted to components.

Routing and trees lose no linked pair of different components; stars and crowds only save work. Sets of all texts are
never stored: they are recomputed for the classes of surviving pairs, each from one of its texts. That text's print (a
hash of its bytes, much cheaper than its set) is found by a Bloom filter of fixed size.

Edge cases: null texts and texts without words are empty sets, linked with nothing and their own component; with fewer
than five words the whole sequence is the one shingle; repeated rows are equal texts; rows with a null doc_id get the
least non-null doc_id of their component, or null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, stream
from styloscope.llm.components import components

WORDS = 5
PERCENT = 80
GROUP_BITS = 20
GROUP_CHUNK = 4096
SKETCHES = 32
DIMENSIONS = 1024
LEAF = 24
FANOUT = 8
CHUNK = 4096
#: Classes of a crowd that the others are held against first.
HUBS = 16
#: A round over the crowds is followed by another one while it links at least one in CROWD_SHARE of their classes.
CROWD_SHARE = 16
BLOOM_BITS = 27
#: Pairs that a task remembers as judged; it only spares judging them again.
SEEN = 1 << 19
#: Bytes of text that are hashed together.
SLAB = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.array([(0xD1B54A32D192ED03 * (2 * k + 1)) & (1 << 64) - 1 | 1 for k in range(SKETCHES)], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    while len(_POWERS[0]) < n:
        size = len(_POWERS[0])
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(base, size, 1 << 64))
            _POWERS[k] = np.concatenate((_POWERS[k], _POWERS[k] * step))
    return _POWERS


def _slab_sets(slab: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([b"", *slab, b""]), np.uint8)
    powers, inverses = _powers(len(data))
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    runs = words[:max(0, len(words) - WORDS + 1)]
    for k in range(1, WORDS):
        runs = _mix(runs * np.uint64(_BASE) + words[k:len(runs) + k])
    limits = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in slab)])).tolist()
    for first, last in zip(limits, limits[1:]):
        if last - first >= WORDS:
            yield np.unique(runs[first:last - WORDS + 1])
        elif last > first:
            few = np.array([last - first], np.uint64)
            for k in range(first, last):
                few = _mix(few * np.uint64(_BASE) + words[k:k + 1])
            yield few
        else:
            yield words[:0]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    slab, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if slab and size + len(data) > SLAB:
            yield from _slab_sets(slab)
            slab, size = [], 0
        slab.append(data)
        size += len(data)
    if slab:
        yield from _slab_sets(slab)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def print_of(text: str) -> int:
    """Names a text: one text of each class is found again by it, without computing the sets of all others."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def least_common(total: int) -> int:
    """Overlap that two sets of together ``total`` elements need to link."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


# --- 1. sets, classes, coarse group counts -------------------------------------------------------------------------

def point_of(shingles: np.ndarray) -> np.ndarray:
    groups = (shingles >> np.uint64(8)) % np.uint64(DIMENSIONS)
    return np.bincount(groups.astype(np.int64), minlength=DIMENSIONS)


def pack_point(point: np.ndarray) -> bytes:
    """Compressed, in the narrowest unsigned type that holds the counts."""
    return zlib.compress(point.astype(np.min_scalar_type(int(point.max()))).tobytes(), 1)


def unpack_point(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(packed)
    return np.frombuffer(raw, f"<u{len(raw) // DIMENSIONS}").astype(np.uint32)


def summarise(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, class, print, mins, point) per document and (task, chunk, counts) of each task's coarse group
    counts."""

    def run(batches) -> Iterator[tuple]:
        from pyspark import TaskContext

        counts = np.zeros(1 << GROUP_BITS, np.int64)
        for doc_ids, texts in batches:
            seen = []
            for doc_id, text, shingles in zip(doc_ids, texts, shingle_sets(texts)):
                seen.append(shingles)
                name = mins = point = None
                if len(shingles):
                    name = print_of(text)
                    mins = [int((shingles * odd).min()) - (1 << 63) for odd in _ODD]
                    point = pack_point(point_of(shingles))
                yield doc_id, len(shingles), class_of(shingles), name, mins, point, None, None, None
            every = np.concatenate(seen)
            counts += np.bincount((every >> np.uint64(64 - GROUP_BITS)).astype(np.int64), minlength=len(counts))
        task = TaskContext.get().partitionId()
        for chunk, part in enumerate(counts.reshape(-1, GROUP_CHUNK)):
            if part.any():
                yield None, None, None, None, None, None, task, chunk, zlib.compress(part.tobytes(), 1)

    return materialise(stream(docs.select(F.col("doc_id").cast("long"), "text"),
                              "doc_id long, n long, class long, print long, mins array<long>, point binary, task int, "
                              "chunk int, counts binary", run), "jaccard-summary")


def classes_of(summary: DataFrame) -> DataFrame:
    """(class, n, least, print, mins, point): distinct non-empty sets with their least doc_id and the print of one of
    their texts."""
    return materialise(
        summary.filter("n > 0").groupBy("class").agg(
            F.max("n").alias("n"), F.min("doc_id").alias("least"),
            F.min("print").alias("print"), F.first("mins").alias("mins"),
            F.first("point").alias("point")), "jaccard-classes")


def coarse_ranks(summary: DataFrame) -> np.ndarray:
    """log2 of each coarse group's count over all texts, one byte each (2^20 bytes)."""
    def added(frame: pd.DataFrame) -> np.ndarray:
        return np.sum([np.frombuffer(zlib.decompress(c), np.int64) for c in frame["counts"]], axis=0)

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [zlib.compress(added(frame).tobytes(), 1)]})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.ceil(np.log2(added(frame) + 1.0)).astype(np.uint8)
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [bits.tobytes()]})

    schema = "chunk int, counts binary"
    summed = (summary.filter("chunk is not null").groupBy("chunk", F.floor(F.col("task") / 128).alias("tasks"))
              .applyInPandas(part, schema).groupBy("chunk").applyInPandas(whole, schema))
    ranks = np.zeros((1 << GROUP_BITS) // GROUP_CHUNK * GROUP_CHUNK, np.uint8)
    for row in summed.collect():  # at most 2^20 bytes in 256 rows
        ranks[row.chunk * GROUP_CHUNK:(row.chunk + 1) * GROUP_CHUNK] = np.frombuffer(row.counts, np.uint8)
    return ranks


# --- 2. routing ------------------------------------------------------------------------------------------------------

def routes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(key, class): the rarest groups of each text, enough to meet those of any linked text."""
    schema = pa.schema([("key", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes, sizes = [], [], []
            for shingles in shingle_sets(batch.column(0).to_pylist()):
                if len(shingles):
                    rank = ranks[(shingles >> np.uint64(64 - GROUP_BITS)).astype(np.int64)]
                    keys.append(shingles[np.argsort(rank, kind="stable")[:prefix_length(len(shingles))]])
                    classes.append(class_of(shingles))
                    sizes.append(len(keys[-1]))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(classes), sizes))],
                    schema=schema)

    return docs.select("text").mapInArrow(run, "key long, class long")


def shared_routes(routed: DataFrame) -> DataFrame:
    """Distinct (key, class) of the keys that more than one class goes to; ``routed`` is stored, as it is read twice."""
    routed = materialise(routed, "jaccard-routed")
    keys = (routed.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"))
            .filter("least < most").select("key"))
    return materialise(routed.join(keys, "key").distinct(), "jaccard-routes")


# --- 3. stars --------------------------------------------------------------------------------------------------------

def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with the centre of every min-hash that it shares, if sizes and points allow a link.

    The centre is the class whose min-hashes are shared most (by the sum of the logarithms of the numbers of classes
    that share them): in a family of edited copies that is the text which they were made from, or one close to it,
    and most of the family links to it though its members hardly link with each other.
    """
    sketches = classes.select("class", F.posexplode("mins").alias("which", "value"))
    sizes = sketches.groupBy("which", "value").agg(F.count("*").alias("size")).filter("size > 1")
    common = materialise(sketches.join(sizes, ["which", "value"]), "jaccard-sketches")
    scores = common.groupBy("class").agg(F.sum(F.log2("size")).alias("score"))
    centres = (common.join(scores, "class").groupBy("which", "value")
               .agg(F.max(F.struct("score", "class")).alias("top")).select("which", "value", F.col("top.class").alias("b")))
    pairs = (common.join(centres, ["which", "value"]).filter(F.col("class") != F.col("b"))
             .select(F.col("class").alias("a"), "b").distinct())
    sides = [classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"point_{x}"))
             for x in "ab"]
    near = (pairs.join(sides[0], "a").join(sides[1], "b")
            .filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")))

    def run(batches) -> Iterator[tuple]:
        for firsts, seconds, sizes_a, sizes_b, points_a, points_b in batches:
            for a, b, n, m, x, y in zip(firsts, seconds, sizes_a, sizes_b, points_a, points_b):
                if int(np.minimum(unpack_point(x), unpack_point(y)).sum()) >= least_common(n + m):
                    yield a, b

    return materialise(stream(near.select("a", "b", "n_a", "n_b", "point_a", "point_b"), "a long, b long", run),
                       "jaccard-stars")


# --- sets of the classes that take part ------------------------------------------------------------------------------

def bloom_of(prints: DataFrame) -> np.ndarray:
    """Bit per print in 2^BLOOM_BITS bits (fixed size; false positives only cost work)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 20), pa.array(slots & (1 << 20) - 1)],
                                             names=["page", "bit"])

    def page(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 20, bool)
        bits[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"page": frame["page"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    slots = prints.mapInArrow(run, "page long, bit long").distinct()
    bloom = np.zeros(1 << BLOOM_BITS, bool)
    for row in slots.groupBy("page").applyInPandas(page, "page long, bits binary").collect():
        bloom[row.page << 20:(row.page + 1) << 20] = np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return np.packbits(bloom)


def asked(texts: list[str | None], bits: np.ndarray) -> list[str]:
    """The texts whose prints the Bloom filter has."""
    out = []
    for text in texts:
        if text:
            slot = (print_of(text) & (1 << 64) - 1) >> (64 - BLOOM_BITS)
            if bits[slot >> 3] >> (7 - (slot & 7)) & 1:
                out.append(text)
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, shingles) once for each class of ``wanted``, from the texts; and a few more."""
    prints = classes.join(wanted, "class", "left_semi").select("print")
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_of(prints))  # 2^BLOOM_BITS bits

    def run(batches) -> Iterator[tuple]:
        for (texts,) in batches:
            for shingles in shingle_sets(asked(texts, bloom.value)):
                if len(shingles):
                    yield class_of(shingles), shingles.tobytes()

    found = stream(docs.select("text"), "class long, shingles binary", run, per_batch=512)
    return found.groupBy("class").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact sets link. Both joins read one exchange of the sets by class."""
    sets = sets_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), classes)
    both = (pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b"))

    def run(batches) -> Iterator[tuple]:
        for firsts, seconds, sets_a, sets_b in batches:
            for a, b, x, y in zip(firsts, seconds, sets_a, sets_b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                    yield a, b

    return materialise(stream(both.select("a", "b", "set_a", "set_b"), "a long, b long", run), "jaccard-links")


# --- 4. trees --------------------------------------------------------------------------------------------------------

class Tree:
    """R-tree over points, bulk-loaded by sorting on size and then on single coordinates.

    Nodes keep the upper corner, the least and greatest size and, if all points share one, the component.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.points, self.sizes, self.parts = points, sizes, parts
        self.root = self._load(np.argsort(sizes, kind="stable"), 0)

    def _load(self, rows: np.ndarray, depth: int) -> tuple:
        if len(rows) <= LEAF:
            children = None
        else:
            if depth:  # below the root: sort by the coordinate that spreads these points most
                rows = rows[np.argsort(self.points[rows][:, np.argmax(np.ptp(self.points[rows], axis=0))], kind="stable")]
            children = [self._load(part, depth + 1) for part in np.array_split(rows, min(FANOUT, -(-len(rows) // LEAF)))]
        parts, sizes = self.parts[rows], self.sizes[rows]
        return (rows, children, self.points[rows].max(axis=0), int(sizes.min()), int(sizes.max()),
                parts[0] if (parts == parts[0]).all() else None)

    def pairs(self, other: Tree) -> Iterator[tuple[int, int]]:
        """Row pairs (self, other) of different components that may link; for the same tree each pair once."""
        for mine, theirs, _ in self.blocks(other):
            yield from zip(mine.tolist(), theirs.tolist())

    def blocks(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of ``pairs`` by leaf, with their bounds, as arrays."""
        stack = [(self.root, other.root)]
        while stack:
            x, y = stack.pop()
            if x[5] is not None and x[5] == y[5] or 100 * x[4] < PERCENT * y[3] or 100 * y[4] < PERCENT * x[3] or int(
                    np.minimum(x[2], y[2]).sum(dtype=np.int64)) < least_common(x[3] + y[3]):
                continue
            if x[1] is None and y[1] is None:
                yield self._leaves(x[0], other, y[0], x is y)
            elif y[1] is None or x[1] is not None and len(x[0]) >= len(y[0]) and x is not y:
                stack += [(child, y) for child in x[1]]
            elif x is y:
                stack += [(a, b) for k, a in enumerate(x[1]) for b in x[1][k:]]
            else:
                stack += [(x, child) for child in y[1]]

    def _leaves(self, mine: np.ndarray, other: Tree, theirs: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
        most = np.minimum(self.points[mine][:, None, :], other.points[theirs][None, :, :]).sum(axis=2, dtype=np.int64)
        a, b = self.sizes[mine][:, None], other.sizes[theirs][None, :]
        keep = (100 + PERCENT) * most >= PERCENT * (a + b)
        keep &= (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        keep &= self.parts[mine][:, None] != other.parts[theirs][None, :]
        if same:
            keep = np.triu(keep, 1)
        i, j = np.nonzero(keep)
        return mine[i], theirs[j], most[i, j]


def group_pairs(rows: list[tuple], seen: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Pairs of one group's rows (mine, low, high, class, part, n, point) that may link; ``seen`` were judged before."""
    low, high = rows[0][1], rows[0][2]
    if len(rows) <= LEAF:
        points: dict[int, np.ndarray] = {}
        for i, (mine, _, _, a, part, n, packed) in enumerate(rows):
            for other, _, _, b, part_b, m, packed_b in rows[i + 1:]:
                if part == part_b or 100 * min(n, m) < PERCENT * max(n, m) or low != high and mine == other:
                    continue
                pair = (a, b) if a > b else (b, a)
                if pair not in seen:
                    seen.add(pair)
                    for name, p in ((a, packed), (b, packed_b)):
                        if name not in points:
                            points[name] = unpack_point(p)
                    if int(np.minimum(points[a], points[b]).sum()) >= least_common(n + m):
                        yield pair
        return
    names, sides, trees = group_trees(rows)
    if trees:
        for i, j in trees[0].pairs(trees[-1]):
            a, b = int(names[sides[0][i]]), int(names[sides[-1][j]])
            pair = (a, b) if a > b else (b, a)
            if pair not in seen:
                seen.add(pair)
                yield pair


def group_trees(rows: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], list[Tree]]:
    """Class names, rows and tree of each side of a group; one side for a chunk with itself, no tree if one is empty."""
    low, high = rows[0][1], rows[0][2]
    mine, names, parts, sizes = (np.array([r[k] for r in rows]) for k in (0, 3, 4, 5))
    points = np.array([unpack_point(r[6]) for r in rows])
    sides = [np.flatnonzero(mine == low)] + [np.flatnonzero(mine == high)] * (low != high)
    if not all(len(side) for side in sides):
        return names, sides, []
    return names, sides, [Tree(points[side], sizes[side], parts[side]) for side in sides]


class Forest:
    """Union-find over class names: ``join`` tells whether two names were apart."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (above := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(above, above)
            x = above
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def group_proposals(rows: list[tuple], forests: tuple[Forest, Forest]) -> Iterator[tuple[int, int]]:
    """Likely links of a crowd's rows: each class with its best hub and its best partner, as far as they join trees of
    the two ``forests``: fewer than two pairs a class, whatever may link."""
    names, sides, trees = group_trees(rows)
    if not trees:
        return
    first, last = trees[0], trees[-1]
    counts = [np.zeros(len(t.sizes), np.int64) for t in trees]
    best = [np.zeros(len(t.sizes)) for t in trees]
    partner = [np.full(len(t.sizes), -1, np.int64) for t in trees]
    for i, j, most in first.blocks(last):
        nearness = most / (first.sizes[i] + last.sizes[j])
        for at, mine, theirs in ((0, i, j), (-1, j, i)):
            counts[at] += np.bincount(mine, minlength=len(counts[at]))
            order = np.argsort(nearness, kind="stable")  # of several pairs of one class the last, nearest one is set
            nearer = order[nearness[order] > best[at][mine[order]]]
            best[at][mine[nearer]], partner[at][mine[nearer]] = nearness[nearer], theirs[nearer]
    found: tuple[list, list] = ([], [])
    for at, facing in {0: -1, len(trees) - 1: 0}.items():
        tree, other = trees[at], trees[facing]
        hubs = np.argsort(-counts[facing], kind="stable")[:HUBS]
        hubs = hubs[counts[facing][hubs] > 0]
        near = np.zeros((len(tree.sizes), len(hubs)))
        for k, hub in enumerate(hubs):
            total = tree.sizes + other.sizes[hub]
            near[:, k] = np.minimum(tree.points, other.points[hub]).sum(axis=1, dtype=np.int64) / total
            near[(tree.parts == other.parts[hub]) | ((100 + PERCENT) * near[:, k] < PERCENT), k] = 0
        for k in range(len(tree.sizes)):
            if len(hubs) and near[k].max() > 0:
                found[0].append((near[k].max(), sides[at][k], sides[facing][hubs[near[k].argmax()]]))
            if partner[at][k] >= 0:
                found[1].append((best[at][k], sides[at][k], sides[facing][partner[at][k]]))
    for pairs, forest in zip(found, forests):
        for _, i, j in sorted(pairs, key=lambda p: -p[0]):
            a, b = int(names[i]), int(names[j])
            if forest.join(a, b):
                yield (a, b) if a > b else (b, a)


def label(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Routes (key, class, part): ``part`` is the class's component by the links found so far."""
    joined = components(links)
    return materialise(
        shared.join(joined, F.col("class") == F.col("node"), "left")
        .select("key", "class", F.coalesce("component", "class").alias("part")), "jaccard-labelled")


def mixed(labelled: DataFrame) -> DataFrame:
    """(key, size) of the groups that hold more than one component."""
    return (labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"),
                                        F.count("*").alias("size")).filter("least < most").select("key", "size"))


def crowds(labelled: DataFrame) -> DataFrame:
    """(key, class, part, size): each class of a group of over LEAF components in the largest such group."""
    rows = labelled.join(mixed(labelled).filter(F.col("size") > LEAF).select("key"), "key")
    crowded = rows.groupBy("key").agg(F.count_distinct("part").alias("size")).filter(F.col("size") > LEAF)
    own = (rows.join(crowded, "key").groupBy("class", "part").agg(F.max(F.struct("size", "key")).alias("top"))
           .select(F.col("top.key").alias("key"), "class", "part"))
    sizes = own.groupBy("key").agg(F.count("*").alias("size"))
    return materialise(own.join(sizes, "key").select("key", "class", "part", "size"), "jaccard-crowds")


def by_group(rows: DataFrame, classes: DataFrame, judge) -> DataFrame:
    """Distinct (a, b) that ``judge`` (a maker of functions from a group's rows to pairs, one per task) yields for the
    groups of ``rows`` (key, class, part, size), dealt to pairs of chunks and read in key order."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = (rows.withColumn("mine", F.pmod(F.xxhash64("class"), chunks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
             .withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
             .join(classes.select("class", "n", "point"), "class"))

    def run(batches) -> Iterator[tuple]:
        group, held, pairs = [], None, judge()
        for columns in batches:
            for key, *row in zip(*columns):
                if (key, row[1], row[2]) != held:
                    if len(group) > 1:
                        yield from pairs(group)
                    group, held = [], (key, row[1], row[2])
                group.append(row)
        if len(group) > 1:
            yield from pairs(group)

    grouped = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return stream(grouped.select("key", "mine", "low", "high", "class", "part", "n", "point"),
                  "a long, b long", run).distinct()


def proposals(crowd: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): likely links within crowds, at most two forests per group."""
    return materialise(by_group(crowd, classes, lambda: lambda group: group_proposals(group, (Forest(), Forest()))),
                       "jaccard-proposals")


def tree_pairs(labelled: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of different components that share a route and pass the trees' bound."""
    def judge():
        seen: set[tuple[int, int]] = set()

        def pairs(group: list[tuple]) -> Iterator[tuple[int, int]]:
            if len(seen) > SEEN:
                seen.clear()
            return group_pairs(group, seen)

        return pairs

    return materialise(by_group(labelled.join(mixed(labelled), "key"), classes, judge), "jaccard-pairs")


# --- the join --------------------------------------------------------------------------------------------------------

def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, n, class), the classes, and links (a, b) that connect all linked classes."""
    prepare(docs.sparkSession)
    summary = summarise(docs)
    classes = classes_of(summary)
    shared = shared_routes(routes(docs, coarse_ranks(summary)))
    links = verified(star_pairs(classes), docs, classes)
    labelled, linking = label(shared, links), True
    while linking and (crowded := (crowd := crowds(labelled)).count()):
        found = verified(proposals(crowd, classes), docs, classes)
        linking = CROWD_SHARE * found.count() >= crowded
        links = links.union(found)
        labelled = label(shared, links)
    more = verified(tree_pairs(labelled, classes), docs, classes)
    return summary.filter("n is not null").select("doc_id", "n", "class"), classes, links.union(more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), class."""
    documents, classes, links = jaccard_links(docs)
    named = materialise(
        classes.join(components(links), F.col("class") == F.col("node"), "left")
        .select("class", F.coalesce("component", "class").alias("component"), "least"), "jaccard-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("class", "component_id")
    return (documents.join(known, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "class"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the least doc_id of every group of linked documents, and its own columns.

    Rows with one doc_id count as one document; rows with a null doc_id go only when their group has another id.
    """
    others = materialise(near_duplicates(docs).filter("component_id is not null and (doc_id is null or "
                                                      "doc_id != component_id)"), "jaccard-others")
    gone = others.filter("doc_id is not null").select(F.col("doc_id").alias("other_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == F.col("other_id"), "left_anti")
    nameless = others.filter("doc_id is null").select(F.col("class").alias("other_class")).distinct()
    if nameless.isEmpty():
        return kept

    @F.pandas_udf("long")
    def class_name(texts: pd.Series) -> pd.Series:
        return pd.Series([class_of(s) for s in shingle_sets(texts.tolist())])

    unnamed = docs.filter("doc_id is null")
    return kept.filter("doc_id is not null").unionByName(
        unnamed.join(nameless, class_name(unnamed["text"]) == F.col("other_class"), "left_anti"))
