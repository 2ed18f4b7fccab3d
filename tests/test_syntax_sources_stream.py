import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import sentences_df
from styloscope.operators.syntax import dependency_depth, heuristic_parse, passive_ratio, subject_overlap, \
    token_depths
from styloscope.sources.tables import sequence_index


def test_rule_parse_and_depths(spark):
    s = sentences_df(spark, ["the famous dog was chased by cats\nwe saw the dog\nit"])
    parse = {(r.sent_idx, r.tok_idx): r for r in heuristic_parse(s).collect()}
    # root of sentence 0 is "was" (first AUX); "the" -> "famous" (ADJ) -> "dog" -> root
    assert parse[(0, 3)].dep == "ROOT" and parse[(0, 0)].head_idx == 1 and parse[(0, 1)].head_idx == 2
    assert parse[(0, 2)].head_idx == 3 and parse[(0, 2)].dep == "nsubj"
    d = {(r.sent_idx, r.tok_idx): r.depth for r in token_depths(heuristic_parse(s)).collect()}
    assert (d[(0, 0)], d[(0, 1)], d[(0, 2)], d[(0, 3)]) == (3, 2, 1, 0)
    avg = {r.sent_idx: r.dependency_avg_depth for r in dependency_depth(heuristic_parse(s)).collect()}
    assert avg[2] == 0.0
    ov = {r.sent_idx: r.subject_overlap_prev for r in subject_overlap(heuristic_parse(s), s).collect()}
    assert ov[0] == 0 and ov[1] == 0


def test_passive_from_table(spark):
    rows = [(0, 0, 0, "cats", "NOUN", 2, "nsubjpass"), (0, 0, 1, "were", "AUX", 2, "dep"),
            (0, 0, 2, "chased", "VERB", 2, "ROOT"), (0, 0, 3, "ran", "VERB", 2, "ccomp")]
    p = spark.createDataFrame(rows, "problem_id long, sent_idx int, tok_idx int, text string, upos string, "
                                    "head_idx int, dep string")
    assert passive_ratio(p).first().passive_ratio == 0.5


def test_cycle_gives_null_depth(spark):
    rows = [(0, 0, 0, 1), (0, 0, 1, 0), (0, 0, 2, 2)]
    p = spark.createDataFrame(rows, "problem_id long, sent_idx int, tok_idx int, head_idx int")
    d = {r.tok_idx: r.depth for r in token_depths(p).collect()}
    assert d == {0: None, 1: None, 2: 0}


def test_sequence_index_matches_row_number(spark):
    random.seed(2)
    ids = random.sample(range(10 ** 6), 300)
    df = spark.createDataFrame([(i % 4, v) for i, v in enumerate(ids)], "g long, vec_id long")
    got = {(r.g, r.vec_id): r.sent_idx for r in sequence_index(df, ["g"], "vec_id", bucket_width=1000).collect()}
    w = Window.partitionBy("g").orderBy("vec_id")
    want = {(r.g, r.vec_id): r.rn for r in df.select("g", "vec_id", (F.row_number().over(w) - 1).alias("rn")).collect()}
    assert got == want


def test_streamed_flagship_equals_batch(spark):
    import __spark_entry__ as entry
    q = entry.queries()
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in q["rhythm_pairs"](spark, sf).collect())
    b = sorted(tuple(r) for r in q["stream_rhythm_pairs"](spark, sf).select(
        "problem_id", "pair_idx", "delta_punctuation_burstiness", "delta_length_variance").collect())
    assert a == b and len(a) > 0


def test_stream_of_a_table_of_several_files(spark, tmp_path):
    import __spark_entry__ as entry
    rows = [(i, f"One line {i}!\nTwo lines, {i}.\nThree? {'x' * i}") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    a = sorted(tuple(r) for r in q["rhythm_pairs"](spark, f"{tmp_path}").collect())
    b = sorted(tuple(r) for r in q["stream_rhythm_pairs"](spark, f"{tmp_path}").select(
        "problem_id", "pair_idx", "delta_punctuation_burstiness", "delta_length_variance").collect())
    assert a == b and len(a) == 24


def test_retried_batch_counts_once_and_runs_resume(spark, tmp_path):
    from styloscope.streaming.problems import problem_file_stream, run_incremental
    (tmp_path / "in" / "easy").mkdir(parents=True)
    (tmp_path / "in" / "easy" / "problem-a1.txt").write_text("one\ntwo")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    seen = []

    def transform(problems):
        seen.append(1)
        return problems.select("problem_id", "difficulty")

    for _ in range(2):  # nothing new the second time
        run_incremental(spark, problem_file_stream(spark, f"{tmp_path}/in"), transform, out, checkpoint=state)
    (tmp_path / "in" / "easy" / "problem-b_2.txt").write_text("three")
    run_incremental(spark, problem_file_stream(spark, f"{tmp_path}/in"), transform, out, checkpoint=state)
    rows = spark.read.parquet(out).select("problem_id", "difficulty").collect()
    assert sorted(tuple(r) for r in rows) == [("a1", "easy"), ("b_2", "easy")] and len(seen) == 2


def test_deep_chain_and_missing_head(spark):
    rows = [(0, 0, k, k - 1 if k else 0) for k in range(200)] + [(0, 1, 0, 0), (0, 1, 1, 9)]
    p = spark.createDataFrame(rows, "problem_id long, sent_idx int, tok_idx int, head_idx int")
    d = {(r.sent_idx, r.tok_idx): r.depth for r in token_depths(p).collect()}
    assert all(d[0, k] == k for k in range(200)) and d[1, 0] == 0 and d[1, 1] is None
