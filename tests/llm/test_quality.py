import re
from collections import Counter

from pyspark.sql import functions as F

from styloscope.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, repeated = len(words), sum(map(len, words)), len(covered)
    symbols, dup = len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 10 or 100 * repeated > 20 * n
    bad = (failed or 10 * symbols > n or chars < 2 * n or chars > 15 * n
           or 10 * len(re.findall("[A-Z]", text)) > 3 * chars or 5 * text.count("!") > n or 10 * dup > 4 * len(lines)
           or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n)
    return n, chars, symbols, dup, repeated, failed, not bad


EDGES = [None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 30, "a b c d e f g h i j " * 2,
         "line one here\nline one here\n\n \nother words on a line of some length\nline one here",
         "a\x0bb\x0cc\rd e f g h i j k", "é😀 ü # * $ % & | < > ok then more words", "WORD " * 4 + "lower case words go on " * 3,
         "stop! now! go! on! and! more! of! this! all! day!", "zz" * 300 + " some of the other words that are here too",
         "p q r s t u v w p q r s t x y z one two three four five six seven eight nine ten eleven twelve " + "k" * 9]


def test_statistics_and_verdict(spark):
    rows = [(k, t, "w", [1]) for k, t in enumerate(EDGES)] + [(None, EDGES[5], "w", [1]), (3, EDGES[8], "w", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, row array<int>")
    got = sorted((tuple(r) for r in q.assess(docs).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r)[1:] for r in q.assess(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_long_text(spark):
    text = " ".join(f"w{k % 9973}" for k in range(40000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tuple(q.assess(docs).first())[1:] == brute(text)


def test_keep_good_keeps_columns_and_any_order_agrees(spark):
    rows = [(k, t, "w") for k, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    want = [k for k, t, _ in rows if brute(t)[-1]]
    for rules in (q.RULES, q.RULES[::-1]):
        kept = q.with_words(docs).filter(q.accepted(rules)).select("row.*")
        assert sorted(r.doc_id for r in kept.collect()) == want
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_order_is_by_rejection_per_cost(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words " * 20).alias("text"))
    rules = [q.Rule("never", lambda t: t("n_words") < 0), q.Rule("always", lambda t: t("n_words") > 0)]
    assert [r.name for r in q.ordered_rules(docs, rules)] == ["always", "never"]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.assess(docs).collect() == [] and q.keep_good(docs).collect() == []
    assert q.ordered_rules(docs) == q.RULES
