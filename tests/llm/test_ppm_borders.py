"""PPM contexts that run over word borders."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from styloscope.llm import ppm
from styloscope.llm.common import held_out


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def spelled(text):
    return b"".join([b" ", *(w + b" " for w in (text or "").encode().lower().split()), b"\n"])


def brute(rows, order=ppm.ORDER):
    """(doc_id, score) with a plain trie of dictionaries over whole texts."""
    trie = defaultdict(Counter)
    for d, t in rows:
        if not held(d):
            text = spelled(t)
            for i in range(1, len(text)):
                for j in range(min(order, i) + 1):
                    trie[text[i - j:i]][text[i]] += 1

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

    return [(d, sum(log_p(x[max(0, i - order):i], x[i]) for i in range(1, len(x)))) for d, t in rows for x in [spelled(t)]]


def scores(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ppm.ppm_scores(docs, ~held_out(F.col("doc_id"), 7, 2), within_words=False)
    return sorted(((r.doc_id, r.score) for r in out.collect()), key=str)


ROWS = [(1, "The cat the CAT sat"), (2, None), (3, ""), (None, "a null id"), (4, "the the the\n\tthe\x0bcat"), (4, "the mat"),
        (5, "Été déjà vu 😀 ÉTÉ"), (9, "unseen wordforms here cat"), (6, "x" * 300 + " long\0zero"), (8, "the"), (17, "qqq cats"),
        *((k, "the quick brown fox jumps over " + "lazy dogs " * (k % 4)) for k in range(30, 60))]


@pytest.mark.parametrize("tokens,cut", [(ppm.BLOCK_TOKENS, ppm.SLICE), (6, 7)])
def test_contexts_run_over_word_borders(spark, monkeypatch, tokens, cut):
    monkeypatch.setattr(ppm, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ppm, "SLICE", cut)
    want = sorted(brute(ROWS), key=str)
    assert any(held(d) for d, _ in ROWS)
    got = scores(spark, ROWS)
    assert [d for d, _ in got] == [d for d, _ in want]
    np.testing.assert_allclose(sorted(s for _, s in got), sorted(s for _, s in want), rtol=1e-9)


def test_word_order_changes_the_score(spark):
    ids = [k for k in range(400) if held(k)][:2]
    rows = [(k, "the quick brown fox jumps over the lazy dog") for k in range(40) if not held(k)]
    rows += [(ids[0], "quick brown fox jumps"), (ids[1], "jumps fox brown quick")]
    got = dict(scores(spark, rows))
    assert got[ids[0]] > got[ids[1]] + 1


def test_query_scores_whole_texts(spark):
    from styloscope.llm.queries import op9_lm_scores
    got = sorted((r.doc_id, r.score) for r in op9_lm_scores(spark, "/root/testdata/sf0.001").collect())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = sorted(brute([(r.doc_id, r.text) for r in docs]))
    assert [d for d, _ in got] == [d for d, _ in want]
    np.testing.assert_allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_packed_grams_and_ids_compress(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 200))) for k in range(150)], "doc_id long, text string")
    rows = ppm.code_blocks(docs.coalesce(1), F.lit(True), 16, False).collect()
    size = {c: sum(len(pa.compress(r[c], codec="lz4_raw", asbytes=True)) for r in rows if r[c]) for c in ("keys", "counts", "ids")}
    grams, tokens = (sum(len(r[c]) for r in rows if r[c]) // width for c, width in (("keys", 8), ("ids", 4)))
    assert size["keys"] < 3 * grams and size["counts"] < 1.5 * grams and size["ids"] < 2.5 * tokens
    for values in (np.array([], np.int64), np.array([5, -1, 1 << 60, 300]), np.array([7, 70_000], np.uint32)):
        assert np.array_equal(ppm.from_planes(ppm.planes(values), values.dtype), values)
