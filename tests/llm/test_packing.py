from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from styloscope.llm import packing as pk

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def check(docs, rows, pieces, window):
    """Round trip, gapless sequences, and the padding that remains."""
    library = Tokenizer.from_file(BYTES)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    for d, ids in want.items():
        parts = sorted(of_doc[d], key=lambda p: p.start)
        assert [i for p in parts for i in np.frombuffer(p.ids, "<u4").tolist()] == ids
        at = 0
        for p in parts:
            assert p.start == at and p.length == len(p.ids) // 4 and p.doc_tokens == len(ids)
            at += p.length
    assert set(of_doc) == set(want)
    padding = 0
    for parts in of_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and {p.tier for p in parts} == {at} and len({p.step_id for p in parts}) == 1
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


@pytest.mark.parametrize("pool", [1 << 20, 3000])
def test_documents(spark, monkeypatch, pool):
    monkeypatch.setattr(pk, "POOL_TOKENS", pool)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    pieces = pk.pack(docs, BYTES, 0).collect()
    check(docs, [(r.doc_id, r.text) for r in docs.collect()], pieces, 1024)
    long = sum(p.length for p in pieces if p.tier == 1024) / sum(p.length for p in pieces)
    assert long > 0.5


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (None, "null id"), (4, "x")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int").coalesce(1)
    check(docs, rows, pk.pack(docs, BYTES, 0, window=256, shortest=16).collect(), 256)
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES, 0).collect() == []
    with pytest.raises(ValueError):
        pk.pack(docs, BYTES, 0, window=1000)


def test_steps_cost_about_the_same():
    rng = np.random.default_rng(4)
    steps = pk.Steps(1 << 13, 0)
    rows = []
    for _ in range(64):
        cuts = np.sort(rng.choice(np.arange(1, 1024), rng.integers(0, 8), replace=False))
        sizes = np.diff(np.concatenate(([0], cuts, [1024])))
        rows += steps.add(1024, [((k, 1), 0, np.zeros(n, np.uint16)) for k, n in enumerate(sizes)])
    rows += steps.deal(1024)
    cost, sequences = defaultdict(int), defaultdict(set)
    for r in rows:
        cost[r[8]] += r[2] ** 2
        sequences[r[8]].add(r[5])
    assert len(cost) == 8 and {len(s) for s in sequences.values()} == {8}
    assert max(cost.values()) < 1.25 * min(cost.values())
