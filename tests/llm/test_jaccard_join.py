import random
import re
from collections import defaultdict

import numpy as np
import pytest

from styloscope.llm import jaccard_join as jj
from styloscope.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (size, component) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    seen = set()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1:]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_shingle_sets_match_tuples():
    texts = ["", None, "a", "a  b\tc\x0bd", "A b C d E", "a b c d e f g a b c d e", "é É x\ny z\r\nw q", "x" * 50,
             " lead and trail of five words here "] * 3
    for text, hashes in zip(texts, jj.shingle_sets(texts)):
        assert len(hashes) == len(shingles(text))
    one, two = jj.shingle_sets(["a b c d", "a b c d "])
    assert np.array_equal(one, two)
    one, two = jj.shingle_sets(["ab c", "a bc"])
    assert not np.array_equal(one, two)


def family(rng, words, base, copies, edits):
    out = []
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("chunk", [4096, 8])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jj, "CHUNK", chunk)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(12))
    texts = [None, "", "   ", "one two", "ONE two", "one two three", passage, passage.upper()]
    for size in (9, 20, 60, 150):
        for copies in (2, 30):
            base = [rng.choice(words) for _ in range(size)]
            texts += family(rng, words, base, copies, max(1, size // 30))
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, class string, n int")
    got, want = result(jj.near_duplicates(docs)), brute(rows)
    assert got == {d: (n, c) for d, (n, c) in want.items()}
    kept = [r.doc_id for r in jj.keep_one(docs).collect()]
    assert sorted(kept) == sorted(d for d, (_, c) in want.items() if c == d)
    assert jj.keep_one(docs).columns == docs.columns


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(jj.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_null_ids_and_repeats(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text + " "), (None, "alone in here")],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jj.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=str)


def test_keep_one_drops_nameless_copies(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(None, text), (7, text), (9, text + " "), (None, "alone in here"), (None, None),
                                  (None, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in jj.keep_one(docs).collect()), key=str)
    assert got == sorted([(7, text), (None, "alone in here"), (None, None), (None, "")], key=str)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_family_without_centre_gives_few_pairs(spark, monkeypatch, chunk):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    shared = [rng.choice(words) for _ in range(40)]
    texts = [t for t in family(rng, words, base, 150, 4) if t != " ".join(base)]
    texts += [" ".join(shared + [rng.choice(words) for _ in range(rng.randrange(5, 40))]) for _ in range(60)]
    rows = list(enumerate(texts))
    made = defaultdict(int)

    def counted(name):
        inner = getattr(jj, name)

        def run(*args):
            out = inner(*args)
            made[name] += out.count()
            return out

        monkeypatch.setattr(jj, name, run)

    monkeypatch.setattr(jj, "CHUNK", chunk)
    monkeypatch.setattr(jj, "star_pairs", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))
    counted("proposals")
    counted("tree_pairs")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jj.near_duplicates(docs)) == {d: (n, c) for d, (n, c) in brute(rows).items()}
    assert 0 < made["proposals"] and made["proposals"] + made["tree_pairs"] < 12 * len(texts)


def test_sets_are_recomputed_from_one_text_a_class(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g "), (3, "h i j k l m n o"), (4, None), (5, ""), (None, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = jj.classes_of(jj.summarise(docs))
    name = {t: jj.class_of(s) for t, s in zip([t for _, t in rows], jj.shingle_sets([t for _, t in rows]))}
    wanted = spark.createDataFrame([(name[rows[0][1]],), (name["p q r"],)], "class long")
    bits = jj.bloom_of(classes.join(wanted, "class", "left_semi").select("print"))
    asked = jj.asked([t for _, t in rows], bits)
    assert len(asked) == 2 and "p q r" in asked and jj.asked([rows[0][1], rows[1][1]], bits) == asked[:1]
    got = {r["class"]: bytes(r.shingles) for r in jj.sets_of(docs, wanted, classes).collect()}
    assert got == {jj.class_of(s): s.tobytes() for s in jj.shingle_sets([rows[0][1], "p q r"])}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jj.near_duplicates(docs).collect() == []


def test_tree_finds_all_pairs_within_bound():
    rng = np.random.default_rng(1)
    sizes = rng.integers(20, 80, 200)
    points = np.array([np.bincount(rng.integers(0, 16, n), minlength=16) for n in sizes]).astype(np.uint32)
    parts = rng.integers(0, 150, 200)
    tree = jj.Tree(points, sizes, parts)
    got = {tuple(sorted(p)) for p in tree.pairs(tree)}
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if parts[i] != parts[j]
            and 180 * int(np.minimum(points[i], points[j]).sum()) >= 80 * (sizes[i] + sizes[j])
            and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j])}
    assert got == want


def test_components_of_chain_star_and_cycle(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(20)] + [(300, 301), (301, 302), (302, 300)]
    pairs += [(400, 400), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {k: 0 for k in range(41)} | {100: 100} | {200 + k: 100 for k in range(20)} | {300: 300, 301: 300, 302: 300}
    assert got == want
