import pytest
from pyspark.sql import functions as F

from conftest import sentences_df
from styloscope.operators import pairs as pr
from styloscope.operators.evaluate import macro_f1


def test_smoothing_constant_and_ends(spark):
    df = spark.createDataFrame([(0, i, 2.0, float(i)) for i in range(4)], "problem_id long, pair_idx int, c double, x double")
    rows = {r.pair_idx: r for r in pr.smooth(df, ["c", "x"]).collect()}
    assert all(r.c_smooth == 2.0 for r in rows.values())
    assert rows[0].x_smooth == 0.5 and rows[1].x_smooth == 1.0 and rows[3].x_smooth == 2.5
    with pytest.raises(ValueError):
        pr.smooth(df, ["c"], window=2)


def test_fill_numeric_nan_inf(spark):
    df = spark.createDataFrame([(0, 0, float("nan"), float("inf"), None, 1)],
                               "problem_id long, pair_idx int, a double, b double, c double, label int")
    r = pr.fill_numeric(df).first()
    assert (r.a, r.b, r.c, r.label) == (0.0, 0.0, 0.0, 1)


def test_assemble_pairs_counts_and_deltas(spark):
    from styloscope.operators.sentences import pair_positions
    s = sentences_df(spark, ["a\nb\nc", "x", "p\nq"])
    sent = s.select("problem_id", "sent_idx", F.length("sentence").cast("double").alias("f"),
                    F.lit(1.0).alias("g"))
    p = pr.assemble_pairs(sent, ["f", "g"], pair_positions(s)).collect()
    assert len(p) == 3 and all(r.delta_f == 0.0 and abs(r.cosine_similarity - 1.0) < 1e-12 and r.label is None for r in p)


def arrays(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_macro_f1_rules(spark):
    truth = arrays(spark, [(1, "easy", [0, 1, 1]), (2, "easy", [1, 0]), (3, "medium", [0, 0]), (4, "hard", [1])],
                   "problem_id long, difficulty string, changes array<int>")
    sol = arrays(spark, [(1, [0, 1, 0]), (2, [1, 0, 0]), (3, [0, 0])], "problem_id long, changes array<int>")
    got = {r.difficulty: r for r in macro_f1(truth, sol).collect()}
    # easy: problem 2 has a length mismatch and is skipped; pairs y=[0,1,1], p=[0,1,0]
    f1_0 = 2 * 1 / (2 * 1 + 1 + 0)
    f1_1 = 2 * 1 / (2 * 1 + 0 + 1)
    assert abs(got["easy"].macro_f1 - (f1_0 + f1_1) / 2) < 1e-12 and got["easy"].n_pairs == 3
    assert got["medium"].macro_f1 == 0.5            # class 1 absent everywhere: F1 0 by zero division
    assert got["hard"].macro_f1 is None             # a truth problem without a solution


def test_stored_pairs_hold_only_the_wanted_columns(spark, tmp_path):
    from styloscope.plans import registry
    rows = [(i, f"The cat ran home, {i}!\nHe has not seen it yet.\nWhy is the dog here?") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = ("cosine_similarity", "deep_style_cosine")
    few = registry._core_pairs(spark, f"{tmp_path}", ("clause_complexity",), wanted)
    assert few.columns == ["problem_id", "pair_idx", *wanted]
    whole = registry._core_pairs(spark, f"{tmp_path}", ("clause_complexity",)).select(few.columns)
    assert sorted(few.collect()) == sorted(whole.collect()) and few.count() == 6
