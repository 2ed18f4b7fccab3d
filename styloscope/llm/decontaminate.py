"""Operator 7: benchmark decontamination by q-gram lemma filtering.

A text region within edit distance k of an item of m characters shares at least t = m - Q + 1 - k * Q of the item's
q-grams with it, on diagonals at most k apart. Per document: look all q-grams up in the items' q-gram table; a cheap
necessary condition (some stretch of TILE positions holds enough hits for any item) drops nearly all text; the rest
counts hits per item in overlapping diagonal bands, retains bands with t hits, and verifies them by banded alignment
of the whole item against the region.

The items are a stated query set. Their q-gram table is made for a block of items of at most BLOCK_CHARS characters
and travels inside the closure; a larger benchmark is processed in several such blocks, each against all documents.
Documents are never shuffled, and a task holds one Arrow batch.

Texts are compared with A-Z and Latin-1 letters lower-cased and each white-space character read as a space, so spans
are positions in the original text.

Edge cases: null and empty texts or items match nothing; items shorter than a q-gram are searched literally; repeated
rows each give their own result; equal items are reported under each of their ids; null ids are carried; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import prepare, stream

Q = 8
#: An item may differ by one edit in so many characters.
CHARS_PER_EDIT = 16
TILE = 64
BLOCK_CHARS = 4 << 20
FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

HITS = "doc_id long, item_id long, first long, last long, edits int"


def codes_of(text: str) -> np.ndarray:
    """Code points, folded; same length as the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    codes[upper] += 32
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def qgrams(codes: np.ndarray) -> np.ndarray:
    """64-bit rolling hash of each run of Q codes, by doubling."""
    h, width, base = codes.astype(np.uint64), 1, np.array([_MIX])  # arrays wrap around, as meant here
    while width < Q:
        h = h[:-width] * base + h[width:] if len(h) > width else h[:0]
        base, width = base * base, width * 2
    return h


def budget(m: int) -> int:
    """Edits allowed for an item of m characters."""
    return m // CHARS_PER_EDIT


def shared_least(m: int) -> int:
    """The q-gram lemma's bound for an item of m characters and its edit budget."""
    return m - Q + 1 - Q * budget(m)


class Items:
    """Q-gram table of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        coded = [(item_id, codes_of(text)) for item_id, text in rows if text]
        self.short = [(i, c) for i, c in coded if len(c) < Q]
        self.items = [(i, c) for i, c in coded if len(c) >= Q]
        lengths = [len(c) for _, c in self.items]
        self.least = np.array([shared_least(m) for m in lengths], np.int64)
        self.edits = np.array([budget(m) for m in lengths], np.int64)
        self.band = int(max([budget(m) for m in lengths], default=0)) + 1
        self.reach = max(lengths, default=0) + self.band
        #: Hits that some TILE positions of a region hold: its t hits lie in so many tiles.
        self.in_tile = int(min([-(-shared_least(m) // -(-(m + budget(m)) // TILE)) for m in lengths], default=0))
        grams = [qgrams(c) for _, c in self.items]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.begin, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(32))) * _MIX) >> np.uint64(64 - FILTER_BITS)

    def search(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, first, last, edits) of the best region of each item that the text holds within its budget."""
        codes = codes_of(text)
        if self.short:
            folded = codes.tobytes()
            for item_id, item in self.short:
                at = folded.find(item.tobytes())
                while at > 0 and at % 4:
                    at = folded.find(item.tobytes(), at + 1)
                if at >= 0:
                    yield item_id, at // 4, at // 4 + len(item), 0
        if len(codes) < Q or not len(self.keys):
            return
        grams = qgrams(codes)
        hit = self.filter[self._slot(grams)]
        at = np.flatnonzero(hit)
        if len(at) < self.in_tile:
            return
        found = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        real = self.keys[found] == grams[at]
        at, found = at[real], found[real]
        # positions in some stretch of TILE that holds in_tile hits
        held = np.searchsorted(at, at + TILE) - np.arange(len(at))
        opens = np.flatnonzero(held >= self.in_tile)
        if not len(opens):
            return
        change = np.zeros(len(at) + 1, np.int64)
        np.add.at(change, opens, 1)
        np.add.at(change, opens + held[opens], -1)
        dense = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        # an item's region may reach past its dense stretch: take in the hits around it
        change[:] = 0
        np.add.at(change, np.searchsorted(at, at[dense] - self.reach), 1)
        np.add.at(change, np.searchsorted(at, at[dense] + self.reach, "right"), -1)
        near = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        yield from self._verify(codes, *self._bands(at[near], found[near]))

    def _bands(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and bands (numbers of band-wide diagonal strips) with enough hits in two adjacent strips."""
        n = self.count[found]
        take = np.repeat(self.begin[found] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, diagonal = self.item[take], np.repeat(at, n) - self.place[take]
        strip = diagonal // self.band
        pair = np.concatenate((item, item)), np.concatenate((strip, strip - 1))  # strips overlap by one
        key = pair[0] * (1 << 40) + pair[1] + (1 << 30)
        keys, hits = np.unique(key, return_counts=True)
        which = keys >> 40
        keep = hits >= self.least[which]
        return which[keep], (keys & ((1 << 40) - 1))[keep] - (1 << 30)

    def _verify(self, codes: np.ndarray, which: np.ndarray, strips: np.ndarray) -> Iterator[tuple]:
        best: dict[int, tuple[int, int, int]] = {}
        for k, strip in zip(which.tolist(), strips.tolist()):
            if k in best and not best[k][0]:
                continue
            item, most = self.items[k][1], int(self.edits[k])
            low = max(0, strip * self.band)
            region = codes[low:max(0, (strip + 2) * self.band + len(item) + most)]
            result = align(item, region, most, 2 * self.band)
            if result and (k not in best or (result[0], low + result[1]) < best[k][:2]):
                best[k] = (result[0], low + result[1], low + result[2])
        for k, (edits, first, last) in best.items():
            yield self.items[k][0], first, last, edits


def align(item: np.ndarray, region: np.ndarray, most: int, starts: int) -> tuple[int, int, int] | None:
    """Fewest edits between ``item`` and a part of ``region`` that begins at most ``starts`` in: (edits, first, last).

    Dynamic programming over the diagonals -most .. starts + most only; None beyond ``most`` edits.
    """
    found = region.tobytes().find(item.tobytes())
    if found >= 0 and found % 4 == 0:
        return 0, found // 4, found // 4 + len(item)
    if not most:
        at = [p for p in range(len(region) - len(item) + 1) if np.array_equal(region[p:p + len(item)], item)]
        return (0, at[0], at[0] + len(item)) if at else None
    width, big = starts + 2 * most + 1, len(item) + len(region) + 1
    step = np.arange(width)
    column = step - most  # of row 0: characters of the region before the diagonal
    cost = np.where((column >= 0) & (column <= len(region)), 0, big)
    origin = column.copy()  # where the part begins
    padded = np.concatenate((np.full(most + 1, 0xFFFFFFFF, np.uint32), region,
                             np.full(len(item) + width, 0xFFFFFFFF, np.uint32)))
    for row, code in enumerate(item):
        column = step - most + row + 1
        inside = (column >= 0) & (column <= len(region))
        diagonal = cost + (padded[row + 1:row + 1 + width] != code)
        above = np.append(cost[1:], big) + 1
        new = np.where(inside, np.minimum(diagonal, above), big)
        start = np.where(diagonal <= above, origin, np.append(origin[1:], 0))
        # a run of region characters that the item lacks: the best cell to the left plus its distance
        leftmost = np.minimum.accumulate((new - step) * width + (width - 1 - step))
        source = width - 1 - leftmost % width
        through = new[source] + step - source
        better = through < new
        if min(new.min(), through.min()) > most:
            return None  # edits never go down from row to row
        cost, origin = np.where(inside & better, through, new), np.where(better, start[source], start)
    end = int(np.argmin(cost))
    if cost[end] > most:
        return None
    return int(cost[end]), max(0, int(origin[end])), int(end - most + len(item))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, each small enough for the driver and a closure."""
    items = benchmark.filter("text is not null and text != ''").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, span first..last (exclusive), edits."""
    prepare(docs.sparkSession)
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], HITS)
    for rows in item_blocks(benchmark):
        def search(batches, rows=rows) -> Iterator[tuple]:
            items = Items(rows)
            for doc_ids, found in batches:
                for doc_id, text in zip(doc_ids, found):
                    for hit in items.search(text):
                        yield doc_id, *hit

        out = out.union(stream(texts, HITS, search))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds an item, with their columns; judged in place, nothing is shuffled."""
    prepare(docs.sparkSession)
    blocks = [[text for _, text in rows] for rows in item_blocks(benchmark)]
    at = docs.columns.index("text")
    kept = docs
    for texts in blocks:
        def clean(batches, texts=texts) -> Iterator:
            import pyarrow as pa

            items = Items([(k, t) for k, t in enumerate(texts)])
            for batch in batches:
                keep = [not t or next(items.search(t), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept
