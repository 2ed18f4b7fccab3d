import json
import os
import tempfile

from pyspark.sql import functions as F

from styloscope.sources.files import read_problem_files, read_solution_files, read_truth


def test_per_file_layout(spark):
    root = tempfile.mkdtemp(prefix="styloscope-files-")
    for diff, pid, text in [("easy", 1, "a\nb\n"), ("hard", "b_2", "  x\ny z  ")]:
        os.makedirs(os.path.join(root, diff), exist_ok=True)
        with open(os.path.join(root, diff, f"problem-{pid}.txt"), "w") as f:
            f.write(text)
        with open(os.path.join(root, diff, f"truth-problem-{pid}.json"), "w") as f:
            json.dump({"changes": [1] * (text.strip().count("\n"))}, f)
    with open(os.path.join(root, "easy", "solution-problem-1.json"), "w") as f:
        json.dump({"changes": [0]}, f, indent=4)
    p = {r.problem_id: r for r in read_problem_files(spark, root).collect()}
    assert p["1"].text == "a\nb" and p["1"].difficulty == "easy"
    assert p["b_2"].text == "x\ny z" and p["b_2"].difficulty == "hard"
    t = {r.problem_id: r.changes for r in read_truth(spark, root).collect()}
    assert t == {"1": [1], "b_2": [1]}
    s = read_solution_files(spark, root).collect()
    assert [(r.problem_id, r.changes, r.problem_name) for r in s] == [("1", [0], "problem-1")]


def test_problem_records_round_trip(spark, tmp_path):
    from styloscope.sources.files import read_problems, write_problems
    rows = [("1", "easy", "a\nb"), ("b_2", "hard", " x\ty ")]
    write_problems(spark.createDataFrame(rows, "problem_id string, difficulty string, text string"), f"{tmp_path}/p")
    got = {(r.problem_id, r.problem_name, r.difficulty, r.text) for r in read_problems(spark, f"{tmp_path}/p").collect()}
    assert got == {("1", "problem-1", "easy", "a\nb"), ("b_2", "problem-b_2", "hard", "x\ty")}


def test_string_ids_through_solution_records(spark, tmp_path):
    from styloscope.operators.evaluate import macro_f1
    from styloscope.sources.files import read_solutions, write_solutions
    rows = [("a1", [0, 1], "easy"), ("7", [1], "hard"), ("007", [0], "hard")]
    solved = spark.createDataFrame(rows, "problem_id string, changes array<int>, difficulty string")
    write_solutions(solved, f"file://{tmp_path}/solutions")
    back = read_solutions(spark, f"file://{tmp_path}/solutions")
    assert sorted((r.problem_id, r.changes, r.difficulty) for r in back.collect()) == sorted(rows)
    assert {r.macro_f1 for r in macro_f1(solved, back.select("problem_id", "changes")).collect()} == {1.0}


def test_small_inputs_are_dealt_out(spark, tmp_path):
    from styloscope.sources.tables import dealt
    path = f"file://{tmp_path}/one"
    spark.range(1000).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    sizes = dealt(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in sizes) == 1000
    spark.range(1000).repartition(8).write.parquet(f"file://{tmp_path}/many")
    many = spark.read.parquet(f"file://{tmp_path}/many")
    assert dealt(many) is many
