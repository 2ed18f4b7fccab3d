import hashlib
import random
import zlib

from pyspark.sql import functions as F

from styloscope.llm import merkle as mk
from styloscope.llm.queries import merkle_columns

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, idx string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings_of(levels, k):
    return [(k >> i ^ 1 < k >> i, levels[i][k >> i ^ 1] if (k >> i ^ 1) < len(levels[i]) else "")
            for i in range(len(levels) - 1)]


def brute(rows):
    """The contract's rows from whole trees in memory."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in order:
        ranked = sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1])))
        built[lang] = ranked, levels_of([leaf_of(r[0], r[3], r[2], r[4], r[1]) for r in ranked])
    forest = levels_of([built[x][1][-1][0] for x in order])
    out = []
    for t, lang in enumerate(order):
        ranked, levels = built[lang]
        for k, r in enumerate(ranked):
            steps = siblings_of(levels, k) + siblings_of(forest, t)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf_of(r[0], r[3], r[2], r[4] + 1, r[1]) if changed else levels[0][k]
            for left, other in steps:
                node = h(other, node) if left else h(node, other)
            out.append((r[0], levels[0][k], levels[-1][0], forest[-1][0], h(*(x for _, x in steps)), node,
                        node == forest[-1][0], k))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"text é {i}" * rng.randint(0, 3), rng.choice(langs), rng.choice(["web", None]), rng.randint(0, 99))
            for i in rng.sample(range(10 ** 6), n)]
    return rows


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = merkle_columns(docs).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "idx")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == brute(rows)
    return got


def test_against_whole_trees(spark, monkeypatch):
    monkeypatch.setattr(mk, "BLOCK_BITS", 2)  # tiers of four leaves, so that small tables have several
    rows = rows_of(150, ["en", "en", "en", "de", None, "", "é"]) + [
        (None, "a", "en", "s", 1), (None, None, "en", "s", 1), (5 * 10 ** 6, "", "xx", None, None),
        (6 * 10 ** 6, "same", "en", "s", 4), (6 * 10 ** 6, "same", "en", "s", 4), (6 * 10 ** 6, "other", "en", "s", 5),
        (-3, "word " * 30000, "de", "s", 150000)]
    check(spark, rows)


def test_sizes(spark, monkeypatch):
    monkeypatch.setattr(mk, "BLOCK_BITS", 1)
    rows = rows_of(41, [""], 2)
    sizes = [1, 1, 2, 3, 4, 5, 7, 8, 10]  # one tree of each size
    langs = [f"l{n}-{k}" for k, n in enumerate(sizes) for _ in range(n)]
    check(spark, [(r[0], r[1], lang, *r[3:]) for r, lang in zip(rows, langs)])


def test_default_blocks(spark):
    got = check(spark, rows_of(1200, ["en"] * 9 + ["de"], 3))
    assert sum(not r.verified for r in got) > 100  # the tampered rows


def test_places_are_a_postorder():
    for n in range(1, 70):
        sizes, order = [n], []
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 2))

        def visit(level, index):
            if level:
                for child in (2 * index, 2 * index + 1):
                    if child < sizes[level - 1]:
                        visit(level - 1, child)
            order.append((level, index))

        visit(len(sizes) - 1, 0)
        assert [mk.place(n, *node) for node in order] == list(range(len(order)))
        leaves = [h(str(i)) for i in range(n)]
        log = mk.append_nodes(leaves, len(sizes) - 1)
        whole = levels_of(leaves)
        assert log == [whole[level][index] for level, index in order]


def test_empty(spark):
    assert merkle_columns(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_columns_and_proof(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1, "x", 1, "y") for i in range(3)], SCHEMA)
    rows = mk.manifest(docs, forge=F.col("doc_id") == 1, forged={"text": F.lit("u")}).collect()
    assert {r.doc_id: r.verified for r in rows} == {0: True, 1: False, 2: True}
    assert all(mk.fold(r.leaf, r.proof) == r.root for r in rows)
