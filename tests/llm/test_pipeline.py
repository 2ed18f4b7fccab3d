import corpus_pipeline as cp
from pyspark.sql import functions as F

from test_decontaminate import fold
from test_jaccard_join import brute as joined
from test_line_dedup import brute as deduped
from test_packing import check as check_packed
from test_quality import brute as judged

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]
    expected = {
        "quality_rules": lambda rows: [(d, t) for d, t in rows if judged(t)[-1]],
        "line_dedup": lambda rows: list(zip((d for d, _ in rows), deduped(rows))),
        "jaccard_join": _kept,
    }
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, SF).cache()
        got = sorted((r.doc_id, r.text) for r in out.collect())
        assert out.columns == columns and out.dtypes == docs.dtypes
        if name in expected:
            assert got == expected[name](rows)
        else:  # literal passages certainly go; nothing without a passage's first or last words goes
            assert not any(i in fold(t) for _, t in got for i in items)
            gone = dict(set(rows) - set(got))
            assert all(any(i[:40] in fold(t) or i[-40:] in fold(t) for i in items) for t in gone.values())
        if name == "line_dedup":
            assert out.filter("n_chars != char_length(text)").isEmpty()
        docs, rows = out, got
    check_packed(docs, rows, stages["packing"](spark, docs, SF).collect(), 1024)


def _kept(rows):
    found = joined(rows)
    return [(d, t) for d, t in rows if found[d][1] == d]


def test_run_is_the_stages(spark):
    out = cp.run(spark, SF)
    assert out.agg(F.sum("length")).first()[0] == out.dropDuplicates(["doc_id"]).agg(F.sum("doc_tokens")).first()[0]


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    more = spark.createDataFrame([(1, None, 2, "a"), (None, "", 3, "b")], "doc_id long, text string, row int, lines string")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).collect() == []
        assert stage(spark, more, SF).columns == more.columns
        assert stage(spark, more, SF).count() == (0 if name == "quality_rules" else 2)
    assert cp.STAGES[-1][1](spark, docs, SF).collect() == []
