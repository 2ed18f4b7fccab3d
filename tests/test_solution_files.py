import json
import os

import pytest

from styloscope.sources.files import read_problem_files, read_solution_files
from styloscope.sources.solution_files import SolutionWriter, write_solution_files

SCHEMA = "problem_id string, changes array<int>, difficulty string, note string"


def files_below(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names
                  if not f.endswith(".crc"))


def test_one_file_per_problem_with_string_ids(spark, tmp_path):
    rows = [("a1", [0, 1], "easy", "x"), ("7", [1], "hard", None), ("007", [0], "hard", None), ("e", [], "hard", None),
            ("n", None, "easy", None)]
    out = f"file://{tmp_path}/solutions"
    solved = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for _ in range(2):  # a second run replaces the same files
        write_solution_files(solved, out)
    assert files_below(f"{tmp_path}/solutions") == sorted(
        ["_SUCCESS"] + [f"{d}/solution-problem-{i}.json" for i, _, d, _ in rows])
    with open(f"{tmp_path}/solutions/easy/solution-problem-a1.json") as f:
        assert json.load(f) == {"changes": [0, 1]}
    got = sorted((r.problem_id, r.changes, r.difficulty) for r in read_solution_files(spark, out).collect())
    assert got == sorted((i, c or [], d) for i, c, d, _ in rows)


def test_retried_task_leaves_one_file(spark, tmp_path):
    row = spark.createDataFrame([("9", [1, 0], None, None)], SCHEMA).first()
    writer = SolutionWriter(f"{tmp_path}/out")
    writer.write(iter([row]))
    writer.write(iter([row]))
    assert files_below(f"{tmp_path}/out") == ["solution-problem-9.json"]


def test_empty_table_and_bad_id(spark, tmp_path):
    write_solution_files(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert files_below(f"{tmp_path}/none") == ["_SUCCESS"]
    for bad in ("../x", None):
        with pytest.raises(Exception, match="no file name"):
            write_solution_files(spark.createDataFrame([(bad, [1], "easy", None)], SCHEMA), f"{tmp_path}/bad")
    assert not os.path.exists(f"{tmp_path}/bad/_SUCCESS")


def test_problems_in_a_single_subfolder_are_found(spark, tmp_path):
    os.makedirs(f"{tmp_path}/easy/train")
    with open(f"{tmp_path}/easy/train/problem-4.txt", "w") as f:
        f.write("a\nb\n")
    got = [(r.problem_id, r.difficulty, r.text) for r in read_problem_files(spark, f"file://{tmp_path}").collect()]
    assert got == [("4", "easy", "a\nb")]
