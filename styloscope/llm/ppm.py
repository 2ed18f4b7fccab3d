"""Operator 9: language-model scores by prediction by partial matching.

The model is a trie of byte contexts up to ORDER bytes, learned from all training texts. A text is a space, its
lower-cased words, each closed by a space, and an end symbol; contexts run over word borders, back to the text's first
byte. A byte is predicted in the longest context seen; when it was not seen there, the model escapes to the next
shorter context and excludes the symbols it has passed over. Each distinct symbol of a context gives half an occurrence
to the escape: its estimate is distinct / (2 * occurrences), a symbol's own (2 * c - 1) / (2 * occurrences).

A byte's code length depends on its (context, byte) gram alone, so everything is a join over distinct things:

1. each task codes its documents as numbers of a vocabulary of its own (a block) and writes both, with the block's
   distinct grams and their training counts, sorted and packed by bucket of grams, in planes of like bytes;
2. vocabularies are summed to the words of the corpus, packed grams to the grams of the corpus. A bucket holds all grams
   of a pair of last context bytes, so it has all nodes of the trie above order 1 that its grams need, and each distinct
   gram is resolved once, in its bucket;
3. gram scores go back to the blocks from the bucket, and every document is spelled again from its block's vocabulary
   and scored from its block's tables.

A common word, gram or passage is one entry per block, so no key is hot; a block has bounded size, a bucket that of the
distinct grams of its pairs. The only things collected are the trie's two lowest orders, at most 256 + 65,536 rows, and
two totals.

``within_words`` cuts contexts at the space before the word; a text's score is then that of its bag of words. No query
asks for it.

Edge cases: a null or empty text is the end symbol alone; null doc_ids count as training rows; repeated rows each
count and get a row; with no training text, every count is 0 and all bytes are equally likely; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, shuffle_partitions, stream

#: Longest context in bytes; a gram (context and byte) fits a long with its length.
ORDER = 5
#: Words of a block's vocabulary and tokens of its documents, at the most one document more.
BLOCK_WORDS = 400_000
BLOCK_TOKENS = 4_000_000
#: Buckets of grams, at the least.
GRAM_BUCKETS = 256
#: Bytes whose grams are counted at a time.
SLICE = 1 << 21
END = b"\n"
SYMBOLS = 256

_CODED = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_()),
                    ("ids", pa.binary()), ("idx", pa.int32()), ("word", pa.binary()), ("n", pa.int64()),
                    ("keys", pa.binary()), ("counts", pa.binary())])


class Vocabulary(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z lower-cased; bytes.split() splits at exactly the ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spelled(words: list[bytes]) -> bytes:
    return b" ".join([b"", *words, END])


def planes(values: np.ndarray) -> bytes:
    """The values' lowest bytes, then their next ones and so on: like bytes lie together and compress, as integers that
    are small or in near order do not otherwise."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def grams_of(text: bytes, first: int, last: int, within_words: bool) -> np.ndarray:
    """The grams of the text's bytes from ``first`` (at least 1) to before ``last``.

    A gram's low bytes are its context and byte, the last byte lowest; its top byte is its length.
    """
    low = max(0, first - ORDER)
    data = np.zeros(ORDER + last - first, np.uint8)  # ORDER bytes before the first, zero before the text
    data[len(data) - (last - low):] = np.frombuffer(text, np.uint8, last - low, low)
    if within_words:
        space = np.maximum.accumulate(np.where(data == ord(" "), np.arange(len(data)), -ORDER))
        length = np.minimum(np.arange(ORDER, len(data)) - space[ORDER - 1:-1], ORDER) + 1
    else:
        length = np.minimum(np.arange(first, last), ORDER) + 1
    key = np.zeros(last - first, np.int64)
    for back in range(ORDER + 1):
        key |= data[ORDER - back:len(data) - back].astype(np.int64) << (8 * back)
    if within_words:
        key &= (1 << 8 * length) - 1
    return key | (length.astype(np.int64) << 56)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of (keys, counts) and their summed counts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


class GramCounts:
    """Distinct grams of a block's texts with their training counts, counted a slice at a time."""

    def __init__(self, within_words: bool):
        self.within_words, self.size = within_words, 0
        self.waiting: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: bytes, training: bool) -> None:
        for first in range(1, len(text), SLICE):
            last = min(first + SLICE, len(text))
            self.waiting[training].append(grams_of(text, first, last, self.within_words))
            self.size += last - first
            if self.size >= SLICE:
                self._count()

    def _count(self) -> None:
        for training, found in self.waiting.items():
            if found:
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                self.parts.append((keys, n if training else np.zeros_like(n)))
                found.clear()
        self.size = 0
        if len(self.parts) >= 8:
            self.parts = [summed(self.parts)]

    def buckets(self, n_buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, keys, counts), the keys by the pair of their last two context bytes and ascending."""
        self._count()
        keys, counts = summed(self.parts)
        pair = keys >> 8 & 0xFFFF  # the last two bytes of the context
        bucket = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(n_buckets)
        order = np.argsort(bucket.astype(np.int64) << 16 | pair, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for k in range(n_buckets):
            if ends[k] < ends[k + 1]:
                part = order[ends[k]:ends[k + 1]]
                yield k, keys[part], counts[part]


def code_blocks(docs: DataFrame, training: Column, n_buckets: int, within_words: bool) -> DataFrame:
    """Rows of kind doc (block, doc_id, training, ids), word (block, idx, word, n: training count) and gram (block,
    idx: bucket, keys, counts: training counts)."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", training.alias("training"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        vocabulary, used, tokens, grams = Vocabulary(), [], 0, GramCounts(within_words)

        def batch(kind: str, **columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            columns |= {"kind": [kind] * n, "block": np.full(n, block)}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns
                                               else pa.nulls(n, f.type) for f in _CODED], schema=_CODED)

        def close() -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(vocabulary), np.int64)
            for ids in used:
                np.add.at(counts, ids, 1) if len(ids) < 64 else np.add(
                    counts, np.bincount(ids, minlength=len(counts)), out=counts)
            words = list(vocabulary)
            for k in range(0, len(words), 65536):
                part = words[k:k + 65536]
                yield batch("word", idx=np.arange(k, k + len(part), dtype=np.int32), word=part,
                            n=counts[k:k + len(part)])
            for k, keys, n in grams.buckets(n_buckets):
                yield batch("gram", idx=[k], keys=[planes(keys)], counts=[planes(n)])

        for found in batches:
            doc_ids, texts, train = (c.to_pylist() for c in found.columns)
            at = 0
            while at < len(texts):
                coded = []
                while at + len(coded) < len(texts) and len(vocabulary) < BLOCK_WORDS and tokens < BLOCK_TOKENS:
                    words = words_of(texts[at + len(coded)])
                    ids = array("I", map(vocabulary.__getitem__, words))
                    grams.add(spelled(words), train[at + len(coded)])
                    tokens += len(ids)
                    coded.append(ids)
                end = at + len(coded)
                if coded:
                    yield batch("doc", doc_id=doc_ids[at:end], training=train[at:end],
                                ids=[planes(np.frombuffer(ids, np.uint32)) for ids in coded])
                    if any(train[at:end]):
                        used.append(np.concatenate([np.frombuffer(ids, np.uint32)
                                                    for ids, t in zip(coded, train[at:end]) if t]))
                at = end
                if len(vocabulary) >= BLOCK_WORDS or tokens >= BLOCK_TOKENS:
                    yield from close()
                    block += 1
                    vocabulary, used, tokens, grams = Vocabulary(), [], 0, GramCounts(within_words)
        yield from close()

    schema = ("kind string, block long, doc_id long, training boolean, ids binary, idx int, word binary, n long, "
              "keys binary, counts binary")
    return materialise(rows.mapInArrow(run, schema), "ppm-blocks", ["kind"])


class LowOrders:
    """Counts of the contexts of no and of one byte (at most 256 + 65,536 rows of the trie)."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.c0, self.c1 = np.zeros(SYMBOLS, np.int64), np.zeros((SYMBOLS, SYMBOLS), np.int64)
        for key, c in rows:
            if key >> 56 == 1:
                self.c0[key & 255] = c
            else:
                self.c1[key >> 8 & 255, key & 255] = c
        self.u0, self.u1 = int((self.c0 > 0).sum()), (self.c1 > 0).sum(axis=1)
        self.t0, self.t1 = int(self.c0.sum()), self.c1.sum(axis=1)
        self.below1 = (self.c1 > 0) @ self.c0

    def levels(self, key) -> list[tuple]:
        """(c, total, distinct, below) of a gram, or of each in an array, for the contexts of one and of no byte."""
        symbol, before = key & 255, key >> 8 & 255
        return [(self.c1[before, symbol], self.t1[before], self.u1[before], self.below1[before]),
                (self.c0[symbol], self.t0, self.u0, 0)]


def log10_probability(levels: list[tuple]):
    """Of a byte, from (c, total, distinct, below) in each context, the longest first; elementwise on arrays.

    ``below``: occurrences, in the next shorter context, of the symbols seen in this one.
    """
    p, excluded, excluded_total, found = 1.0, 0, 0, False
    for c, total, distinct, below in levels:
        seen = np.logical_not(found) & (total > 0)  # a context never seen: nothing to escape from
        here = seen & (c > 0)
        new, occurrences = distinct - excluded, np.where(seen, total - excluded_total, 1)
        p = p * np.where(here, (2 * c - 1) / (2 * np.maximum(occurrences, 1)),
                         np.where(seen & (new > 0), new / (2 * np.maximum(occurrences, 1)), 1.0))
        found = found | here
        excluded, excluded_total = np.where(seen, distinct, excluded), np.where(seen, below, excluded_total)
    return np.log10(np.where(found, p, p / np.maximum(1, SYMBOLS - excluded)))


def resolve(keys: np.ndarray, counts: np.ndarray, low: LowOrders) -> np.ndarray:
    """log10 probability of each distinct gram of a bucket, from the bucket's training counts."""
    size, levels, shorter = keys >> 56, low.levels(keys), low.c1[keys >> 8 & 255, keys & 255]
    for length in range(3, ORDER + 2):
        at = np.flatnonzero(size >= length)
        node, first, place = np.unique(keys[at] & ((1 << 8 * length) - 1), return_index=True, return_inverse=True)
        c = np.bincount(place, counts[at], len(node)).astype(np.int64)
        _, context = np.unique(node >> 8, return_inverse=True)
        total, distinct, below = (np.bincount(context, x) for x in (c, c > 0, np.where(c > 0, shorter[at][first], 0)))
        level = np.zeros((4, len(keys)), np.int64)
        level[:, at] = [c[place], *(x.astype(np.int64)[context][place] for x in (total, distinct, below))]
        levels.insert(0, tuple(level))
        shorter = level[0]
    return log10_probability(levels)


def corpus_grams(packed: DataFrame) -> DataFrame:
    """Rows (bucket, keys, counts) of the corpus from the blocks' packed grams, and (low, n): counts of the grams' last
    two bytes, by bucket."""

    def add_up(batches) -> Iterator[tuple]:
        held, parts, size = None, [], 0

        def flush() -> Iterator[tuple]:
            if parts:
                keys, counts = summed(parts)
                yield held, planes(keys), planes(counts), None, None
                low, place = np.unique(keys & 0xFFFF, return_inverse=True)
                for k, n in zip(low.tolist(), np.bincount(place, counts).tolist()):
                    if n:
                        yield held, None, None, k, int(n)

        for buckets, keys, counts in batches:
            for bucket, k, n in zip(buckets, keys, counts):
                if bucket != held:
                    yield from flush()
                    held, parts, size = bucket, [], 0
                parts.append((from_planes(k), from_planes(n)))
                size += len(parts[-1][0])
                if size > SLICE and len(parts) > 1:
                    parts, size = [summed(parts)], 0
        yield from flush()

    by_bucket = (packed.select(F.col("idx").alias("bucket"), "keys", "counts").repartition("bucket")
                 .sortWithinPartitions("bucket"))
    return materialise(stream(by_bucket, "bucket int, keys binary, counts binary, low int, n long", add_up), "ppm-grams")


def block_scores(packed: DataFrame) -> DataFrame:
    """(of_block, keys, logps): the blocks' packed grams with their scores."""
    grams = corpus_grams(packed)
    pairs = [(r.low, r.n) for r in grams.filter("low is not null").groupBy("low").agg(F.sum("n").alias("n")).collect()]
    low = LowOrders([(2 << 56 | k, n) for k, n in pairs]
                    + [(1 << 56 | s, sum(n for k, n in pairs if k & 255 == s)) for s in {k & 255 for k, _ in pairs}])
    rows = (grams.filter("keys is not null").select("bucket", F.lit(None).cast("long").alias("block"), "keys", "counts")
            .union(packed.select(F.col("idx").alias("bucket"), "block", "keys", F.lit(None).cast("binary"))))

    def look_up(batches) -> Iterator[tuple]:
        for _, blocks, packed_keys, counts in batches:
            for block, k, n in zip(blocks, packed_keys, counts):
                found = from_planes(k)
                if block is None:  # a bucket's grams come before its blocks
                    keys, logps = found, resolve(found, from_planes(n), low)
                else:
                    yield block, k, logps[np.searchsorted(keys, found)].tobytes()

    by_bucket = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    return stream(by_bucket, "of_block long, keys binary, logps binary", look_up, per_batch=64)


def ppm_scores(docs: DataFrame, training: Column, within_words: bool = True) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score, score for every row; see the module.

    ``base_score``: add-one smoothed unigram score of words and end symbol; ``score``: the model's log10 probability.
    """
    spark = docs.sparkSession
    prepare(spark)
    n_buckets = max(shuffle_partitions(spark), GRAM_BUCKETS)
    coded = code_blocks(docs, training, n_buckets, within_words)
    texts, vocabulary, packed = (coded.filter(F.col("kind") == kind) for kind in ("doc", "word", "gram"))
    ends = texts.filter("training").count()
    words = materialise(vocabulary.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    total, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, types = total + ends, known + (ends > 0)
    floor = float(np.log10(tokens + types + 1))
    table = (vocabulary.select(F.col("block").alias("of_block"), "idx", "word").join(words, "word")
             .unionByName(block_scores(packed), allowMissingColumns=True)
             .select("of_block", "idx", "word", "n", "keys", "logps"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        coded_words, grams = right[right["keys"].isna()], right[right["keys"].notna()]
        size = len(coded_words)
        n, spelling = np.zeros(size, np.int64), np.empty(size, object)
        idx = coded_words["idx"].to_numpy().astype(np.int64)
        n[idx], spelling[idx] = coded_words["n"].to_numpy(), coded_words["word"].to_numpy()
        keys = np.concatenate([np.zeros(0, np.int64), *map(from_planes, grams["keys"])])
        order = np.argsort(keys)
        keys, logp = keys[order], np.frombuffer(b"".join(grams["logps"]), np.float64)[order]
        base, seen = np.log10(n + 1.0) - floor, n > 0
        out = []
        for raw in left["ids"]:
            ids = from_planes(raw, np.uint32)
            text, found = spelled(spelling[ids].tolist()), 0.0
            for first in range(1, len(text), SLICE):
                wanted = grams_of(text, first, min(first + SLICE, len(text)), within_words)
                found += float(logp[np.searchsorted(keys, wanted)].sum())
            out.append((len(ids) + 1, int(seen[ids].sum()) + (ends > 0), float(base[ids].sum()) + float(
                np.log10(ends + 1.0)) - floor, found))
        frame = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        # a nullable integer column: null doc_ids must not turn ids into floating point
        frame.insert(0, "doc_id", left["doc_id"].astype("Int64").to_numpy(object))
        frame.insert(1, "training", left["training"].to_numpy())
        return frame

    out = (texts.select("block", F.col("doc_id"), "training", "ids").groupBy("block")
           .cogroup(table.groupBy("of_block"))
           .applyInPandas(score, "doc_id long, training boolean, n_tokens long, n_known long, base_score double, "
                                 "score double"))
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))
