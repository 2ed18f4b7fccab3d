import random

import numpy as np

from styloscope.llm import decontaminate as dc


def fold(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c
                   for c in text)


def distance(item, text):
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    found = {}
    for d, text in docs:
        for k, item in items:
            if text and item:
                edits = distance(fold(item), fold(text))
                if edits <= len(item) // dc.CHARS_PER_EDIT:
                    found[d, k] = edits
    return found


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(k, rng.choice("abcdefgh "))
        else:
            del out[k]
    return "".join(out)


def test_matches_edit_distance(spark):
    rng = random.Random(8)
    words = ["the", "of", "and", "to", "in", "erst", "thin", "ouer", "hand", "rest", "Été"]
    passage = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(k, passage(n)) for k, n in enumerate((3, 5, 8, 12, 20, 30))]
    items += [(50, ""), (51, None), (52, "qz"), (53, items[2][1])]
    docs = [(0, None), (1, ""), (2, passage(60)), (3, "an qz here"), (4, "short")]
    for n, (k, item) in enumerate(items[:6]):
        for edits in range(0, len(item) // dc.CHARS_PER_EDIT + 3):
            part = edited(rng, item.upper() if edits % 2 else item.replace(" ", "\n"), edits)
            docs.append((100 * n + edits + 10, f"{passage(6)} {part}{passage(8)}"))
            docs.append((100 * n + edits + 50, part))
    table = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, first string")
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    rows = dc.find_leaks(table, bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == want and len(rows) == len(want)
    texts, by_id = dict(docs), dict(items)
    for r in rows:
        assert distance(fold(by_id[r.item_id]), fold(texts[r.doc_id][r.first:r.last])) == r.edits
    kept = dc.drop_leaks(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(tuple(r) for r in dc.find_leaks(docs, bench).collect())
    kept = sorted(r.doc_id for r in dc.drop_leaks(docs, bench).collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    literal = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if r.text in t}
    assert literal and literal <= {(r[0], r[1]) for r in one}
    assert kept == sorted(set(texts) - {r[0] for r in one})
    monkeypatch.setattr(dc, "BLOCK_CHARS", 3000)
    assert len(list(dc.item_blocks(bench))) > 2
    assert sorted(tuple(r) for r in dc.find_leaks(docs, bench).collect()) == one
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, bench).collect()) == kept


def test_long_text_and_repeats(spark):
    item = "a passage of the benchmark that is long enough to be found again"
    text = "filler words go on and on " * 20000 + item + " more"
    docs = spark.createDataFrame([(1, text), (1, text), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, item), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.first, r.last) for r in dc.find_leaks(docs, bench).collect()), key=str)
    at = text.index(item)
    want = [(1, k, at, at + len(item)) for k in (5, 6, None)] * 2 + [(None, k, 0, len(item)) for k in (5, 6, None)]
    assert got == sorted(want, key=str)


def test_empty(spark):
    docs, bench = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id long, text string"))
    full = spark.createDataFrame([(1, "some text that is here")], "doc_id long, text string")
    assert dc.find_leaks(docs, bench).collect() == dc.find_leaks(full, bench).collect() == []
    assert dc.drop_leaks(full, bench).count() == 1
    items = spark.createDataFrame([(1, "some text that is here")], "item_id long, text string")
    assert dc.find_leaks(docs, items).collect() == [] and dc.drop_leaks(docs, items).count() == 0


def test_align_agrees_with_full_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(8, 40)))
        most = rng.randrange(0, 4)
        before = rng.randrange(0, 6)
        region = "".join(rng.choice("abc ") for _ in range(before)) + edited(rng, item, rng.randrange(0, 6)) + "zz"
        codes = lambda t: np.array([ord(c) for c in t], "<u4")
        got = dc.align(codes(item), codes(region), most, before + 6)
        edits = distance(item, region)
        if edits <= most:
            assert got and got[0] == edits and distance(item, region[got[1]:got[2]]) == edits
        else:
            assert got is None
