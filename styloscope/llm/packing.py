"""Operator 6: hierarchical multi-length packing.

Tiers are power-of-two windows up to ``window`` tokens. A document's ids are cut into full windows of the longest
tier; the rest goes to the shortest tier that holds it. Each tier is packed from the longest to the shortest: a
piece opens a window of its tier and the gap behind it is filled from shorter tiers, first with the longest whole
piece that fits, then, when none does, with the head of a longer one whose tail goes back to its tier. What is left
at the end of a task is cut into windows of exact powers of two. No sequence needs padding then.

Sequences of a tier form step groups of ``step_tokens`` tokens; a few steps' sequences at a time are ordered by
attention cost (sum of squared piece lengths) and dealt out in a snake, so the steps of a tier cost about the same.

Every task packs the documents of its own input partition in pools of bounded size: memory does not depend on the
partition or a document's share of the rows, nothing is shuffled, and a retried task gives the same sequences.

Edge cases: a null text is empty (its end id is packed); null, equal and repeated doc_ids are packed row by row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from styloscope.llm.common import prepare, stream
from styloscope.llm.encode import encoder

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_id long")
#: Tokens of document remainders that are packed together.
POOL_TOKENS = 1 << 20
#: Steps whose sequences are balanced against each other.
BALANCED_STEPS = 8

#: A piece: document row (doc_id, doc_tokens), start in it, ids.
Piece = tuple[tuple[int | None, int], int, np.ndarray]


class Pool:
    """Pieces by length; a bit mask of the lengths present finds the best fit."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = defaultdict(list)
        self.present = 0

    def add(self, piece: Piece) -> None:
        n = len(piece[2])
        self.by_length[n].append(piece)
        self.present |= 1 << n

    def take(self, n: int) -> Piece:
        pieces = self.by_length[n]
        piece = pieces.pop()
        if not pieces:
            self.present &= ~(1 << n)
        return piece

    def longest(self, low: int, high: int) -> int:
        """Largest present length in low..high, or 0."""
        found = (self.present & ((1 << high + 1) - 1)).bit_length() - 1
        return found if found >= low else 0

    def shortest(self, low: int, high: int) -> int:
        """Smallest present length in low..high, or 0."""
        above = self.present >> low
        found = low + (above & -above).bit_length() - 1 if above else 0
        return found if found <= high else 0


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids = piece
    return (doc, start, ids[:n]), (doc, start + n, ids[n:])


def tiers_of(window: int, shortest: int) -> list[int]:
    """Window sizes from the longest down."""
    if window & (window - 1) or shortest & (shortest - 1) or not 0 < shortest <= window:
        raise ValueError("tiers are powers of two")
    return [1 << k for k in range(window.bit_length() - 1, shortest.bit_length() - 2, -1)]


def pack_pool(pool: Pool, tiers: list[int]) -> Iterator[tuple[int, list[Piece]]]:
    """Full windows (tier, pieces) from the pool; pieces that fill no window stay in it."""
    unfilled: list[Piece] = []
    for tier in tiers:
        low = tier // 2 + 1 if tier != tiers[-1] else 1
        while n := pool.longest(low, tier):
            pieces, gap = [pool.take(n)], tier - n
            while gap:
                if n := pool.longest(1, gap):
                    pieces.append(pool.take(n))
                elif n := pool.shortest(gap + 1, tier):
                    head, tail = cut(pool.take(n), gap)
                    pieces.append(head)
                    pool.add(tail)
                else:
                    break
                gap -= len(pieces[-1][2])
            if gap:
                unfilled += pieces
            else:
                yield tier, pieces
    for piece in unfilled:
        pool.add(piece)


def finish(pool: Pool) -> Iterator[tuple[int, list[Piece]]]:
    """Everything left in the pool, in windows of exact powers of two, longest first."""
    pieces = [p for n in sorted(pool.by_length, reverse=True) for p in pool.by_length[n]]
    left = sum(len(p[2]) for p in pieces)
    pieces.reverse()
    while left:
        size = gap = 1 << left.bit_length() - 1
        inside = []
        while gap:
            piece = pieces.pop()
            if len(piece[2]) > gap:
                piece, tail = cut(piece, gap)
                pieces.append(tail)
            inside.append(piece)
            gap -= len(piece[2])
        left -= size
        yield size, inside


class Steps:
    """Deals windows of each tier into step groups of about equal attention cost."""

    def __init__(self, step_tokens: int, base: int):
        self.step_tokens, self.next_step, self.next_sequence = step_tokens, base, base
        self.waiting: dict[int, list[list[Piece]]] = defaultdict(list)

    def add(self, tier: int, pieces: list[Piece]) -> Iterator[tuple]:
        self.waiting[tier].append(pieces)
        if len(self.waiting[tier]) >= BALANCED_STEPS * max(1, self.step_tokens // tier):
            yield from self.deal(tier)

    def deal(self, tier: int) -> Iterator[tuple]:
        windows = self.waiting.pop(tier, [])
        windows.sort(key=lambda pieces: -sum(len(p[2]) ** 2 for p in pieces))
        steps = -(-len(windows) // max(1, self.step_tokens // tier))
        for k, pieces in enumerate(windows):
            lap, seat = divmod(k, steps)
            step = self.next_step + (steps - 1 - seat if lap % 2 else seat)
            offset = 0
            for (doc_id, doc_tokens), start, ids in pieces:
                yield (doc_id, start, len(ids), ids.astype("<u4").tobytes(), doc_tokens, self.next_sequence, offset,
                       tier, step)
                offset += len(ids)
            self.next_sequence += 1
        self.next_step += steps


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 1024, shortest: int = 64,
         step_tokens: int = 1 << 16) -> DataFrame:
    """Pieces of packed sequences with their ids (little-endian unsigned 32-bit): see SCHEMA.

    ``window``: longest tier; ``shortest``: shortest tier that is packed; ``step_tokens``: tokens of a step group.
    """
    prepare(docs.sparkSession)
    tiers = tiers_of(window, shortest)

    def rows(batches) -> Iterator[tuple]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        dtype = enc.dtype if end_id < 1 << 8 * enc.width else np.dtype("<u4")
        end = np.array([end_id], dtype)
        steps = Steps(step_tokens, TaskContext.get().partitionId() << 33)
        pool, pooled = Pool(), 0
        for doc_ids, texts in batches:
            for doc_id, ids in zip(doc_ids, enc.encode(texts)):
                ids = np.concatenate((ids.astype(dtype, copy=False), end))
                doc, whole = (doc_id, len(ids)), len(ids) // window * window
                for start in range(0, whole, window):
                    yield from steps.add(window, [(doc, start, ids[start:start + window])])
                if whole < len(ids):
                    pool.add((doc, whole, ids[whole:].copy()))
                    pooled += len(ids) - whole
                if pooled >= POOL_TOKENS:
                    for tier, pieces in pack_pool(pool, tiers):
                        yield from steps.add(tier, pieces)
                    pooled = sum(n * len(p) for n, p in pool.by_length.items())
        for tier, pieces in pack_pool(pool, tiers):
            yield from steps.add(tier, pieces)
        for tier, pieces in finish(pool):
            yield from steps.add(tier, pieces)
        for tier in sorted(steps.waiting, reverse=True):
            yield from steps.deal(tier)

    return stream(docs.select("doc_id", "text"), SCHEMA, rows)
