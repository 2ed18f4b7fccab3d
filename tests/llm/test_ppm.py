import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from styloscope.llm import ppm
from styloscope.llm.common import held_out


def brute(rows, order=ppm.ORDER):
    """(doc_id, held_out) -> (n_tokens, n_known, N, base, score) with a plain trie of dictionaries."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            train.update((t or "").encode().lower().split())
            ends += 1
    trie = defaultdict(Counter)
    for word, n in [*train.items(), *([(None, ends)] if ends else [])]:
        text = b" \n" if word is None else b" " + word + b" "
        for i in range(1, len(text)):
            for j in range(min(order, i) + 1):
                trie[text[i - j:i]][text[i]] += n

    def log_p(context, symbol):
        p, gone = 1.0, set()
        for j in range(len(context), -1, -1):
            node = {s: c for s, c in trie.get(context[len(context) - j:], {}).items() if s not in gone}
            if symbol in node:
                return math.log10(p * (2 * node[symbol] - 1) / (2 * sum(node.values())))
            if node:
                p *= len(node) / (2 * sum(node.values()))
            gone |= set(node)
        return math.log10(p / max(1, 256 - len(gone)))

    def spelled(word):
        text = b" \n" if word is None else b" " + word + b" "
        return sum(log_p(text[max(0, i - order):i], text[i]) for i in range(1, len(text)))

    total, types = sum(train.values()) + ends, len(train) + (ends > 0)
    counts = {**train, None: ends}
    out = []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + types + 1)) for w in words)
        out.append((d, held(d), len(words), sum(counts.get(w, 0) > 0 for w in words), total, base, sum(map(spelled, words))))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, word string, n int")
    out = ppm.ppm_scores(docs, ~held_out(F.col("doc_id"), 7, 2))
    got = sorted(((r.doc_id, not r.training, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
                  for r in out.collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


EDGES = [(1, "The cat the CAT sat"), (2, None), (3, ""), (None, "a null id"), (4, "the the the\n\tthe\x0bcat"), (4, "the mat"),
         (5, "Été déjà vu 😀 ÉTÉ"), (9, "unseen wordforms here cat"), (6, "x" * 3000 + " long"), (7, " . ! the."), (8, "the"),
         (11, "zq"), (17, "qqq cats"), (23, "catalogue")]


@pytest.mark.parametrize("words,tokens", [(ppm.BLOCK_WORDS, ppm.BLOCK_TOKENS), (4, 6)])
def test_edges_match_a_plain_trie(spark, monkeypatch, words, tokens):
    monkeypatch.setattr(ppm, "BLOCK_WORDS", words)
    monkeypatch.setattr(ppm, "BLOCK_TOKENS", tokens)
    rows = EDGES + [(k, "the quick brown fox jumps over " + "lazy dogs " * (k % 4)) for k in range(30, 60)]
    assert any(r[1] for r in brute(rows)) and not all(r[1] for r in brute(rows))
    check(spark, rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_nothing_to_learn_from(spark):
    only = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    check(spark, [(only, "all held out"), (only, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.ppm_scores(empty, F.lit(True)).collect() == []


def test_probabilities_of_a_context_sum_to_one():
    low = ppm.LowOrders([(1 << 56 | 97, 3), (1 << 56 | 98, 1), (2 << 56 | 97 << 8 | 98, 1), (2 << 56 | 97 << 8 | 97, 2)])
    for before in (97, 98, 99):
        total = sum(10 ** ppm.log10_probability(low.levels(2 << 56 | before << 8 | s)) for s in range(256))
        assert total == pytest.approx(1)
