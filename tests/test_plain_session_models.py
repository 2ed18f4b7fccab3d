"""Queries that fit something (scaler, components, trees) run to the end in a session without any of the library's
settings."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import json, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/kept").getOrCreate())
docs = [(0, "One cat, two dogs.\\nFour cats were seen!\\nWhy?"), (1, "She sat there."), (24, "The end.\\nMust it end?"),
        (25, "A dog ran home, quickly.")]
spark.createDataFrame(docs, "doc_id long, text string").write.parquet(sys.argv[1] + "/documents.parquet")
vectors = [(k, k % 2, [float((k * j) % 7) for j in range(1, 17)]) for k in range(12)]
spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(
    sys.argv[1] + "/embeddings.parquet")
import __spark_entry__ as entry
for name in sys.argv[2:]:
    print(name, json.dumps([list(r) for r in entry.queries()[name](spark, sys.argv[1]).collect()]))
"""


def rows_of(name, tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), name], cwd=REPO, capture_output=True, text=True,
                          timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(next(x for x in done.stdout.splitlines() if x.startswith(f"{name} ")).split(" ", 1)[1])


def test_minmax_scale_in_a_plain_session(tmp_path):
    got = {(r[0], r[1]): r[2:] for r in rows_of("minmax_scale", tmp_path)}
    # three lines have the positions 0 and 1/2, two lines 0: scaled to 0, 1 and 0
    assert {k: v[0] for k, v in got.items()} == {(0, 0): 0.0, (0, 1): 1.0, (24, 0): 0.0}
    ranges = [(min(column), max(column)) for column in zip(*got.values())]
    assert ranges[:3] == [(0.0, 1.0)] * 3 and ranges[3] in [(0.0, 1.0), (0.0, 0.0)]  # a constant column maps to 0


def test_embedding_pca_in_a_plain_session(tmp_path):
    got = rows_of("embedding_pca", tmp_path)
    assert sorted((r[0], r[1]) for r in got) == [(p, i) for p in range(2) for i in range(6)]
    assert all(abs(sum(r[3:]) - r[2] ** 2) < 1e-3 for r in got)  # six decimals are returned


def test_collect_changes_in_a_plain_session(tmp_path):
    got = rows_of("collect_changes", tmp_path)
    # problem 0 trains (md5 of its id begins with c), problem 6 is held out (1); both are scored, a value for each pair
    assert sorted((p, difficulty, len(changes)) for p, difficulty, changes in got) == [(0, "easy", 3), (6, "easy", 2)]
    assert {x for _, _, changes in got for x in changes} <= {0, 1}
