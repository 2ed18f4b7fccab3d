"""Queries in a session that was built without any of the library's settings, as a driver or a cluster does."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/kept").getOrCreate())
rows = [(1, "One, two; three.\\nFour five!"), (2, "Six.\\nSeven, eight.\\nNine?"), (3, None)]
spark.createDataFrame(rows, "doc_id long, text string").write.parquet(sys.argv[1] + "/documents.parquet")
import __spark_entry__ as entry
for name in ("sentence_split", "min_length_filter", "lexical_stats", "rhythm_pairs"):
    print(name, sorted((r[0], r[1]) for r in entry.queries()[name](spark, sys.argv[1]).collect()))
"""


def test_queries_run_in_a_session_without_the_librarys_settings(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    got = dict(line.split(" ", 1) for line in done.stdout.splitlines() if " " in line)
    sentences = [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    assert got["sentence_split"] == got["lexical_stats"] == str(sentences)
    assert got["min_length_filter"] == "[(1, 2), (2, 3)]"
    assert got["rhythm_pairs"] == "[(1, 0), (2, 0), (2, 1)]"
