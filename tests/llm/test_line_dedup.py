import random

from styloscope.llm.line_dedup import dedup_lines, without_repeats


def brute(rows):
    """Texts after removal, row by row; rows with one doc_id are one document."""
    key = lambda d: (d is not None, d or 0)
    windows = []
    for k, (doc, text) in enumerate(rows):
        lines = [x.strip(" \t\x0b\f\r") for x in (text or "").split("\n")]
        windows += [(tuple(lines[p:p + 3]), key(doc), k, p) for p in range(len(lines) - 2) if any(lines[p:p + 3])]
    least = {}
    for w, doc, _, _ in windows:
        least[w] = min(least.get(w, doc), doc)
    seen, cut = set(), {}
    for w, doc, k, p in sorted(windows, key=lambda x: x[1:]):
        if doc > least[w] or (w, k) in seen:
            cut.setdefault(k, set()).update(range(p, p + 3))
        seen.add((w, k))
    return [text if k not in cut else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut[k])
            for k, (_, text) in enumerate(rows)]


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, k, "z") for k, (d, t) in enumerate(rows)],
                                 "doc_id long, text string, lines int, pairs string")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert [r.text for r in sorted(out.collect(), key=lambda r: r.lines)] == brute(rows)


def test_cases(spark):
    check(spark, [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, "b\n c \nd\t\nb\nc\nd\nb"), (5, None), (6, ""),
                  (7, "a\nb"), (8, "\n\n\n\n"), (9, "\n\n\nq"), (10, "r\nr\nr\nr\nr"), (None, "x\ny\nz"), (0, "x\ny\nz\nw"),
                  (12, "u\nv\nw"), (12, "u\nv\nw"), (12, "t\nu\nv\nw"), (13, "u\nv\nw\nu\nv\nw")])


def test_random(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice("abcd ") for _ in range(rng.randrange(14))))
            for _ in range(120)]
    check(spark, rows)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in without_repeats(docs).collect()}
    assert got == dict(zip((d for d, _ in rows), brute(rows)))


def test_removed_lines_and_long_text(spark):
    text = "\n".join(str(k) for k in range(30000))
    docs = spark.createDataFrame([(1, text), (2, "head\n" + text)], "doc_id long, text string")
    got = {r.row.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[1].removed == [] and got[2].row.text == "head" and len(got[2].removed) == 30000


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
