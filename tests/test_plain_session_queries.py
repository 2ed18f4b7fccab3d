"""Queries are built, with the jobs they run meanwhile, in a session without any of the library's settings; quick ones
also return their rows there."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["char_ratios", "clause_ratio", "dep_depth", "directional_cosine", "embedding_pairs", "embedding_vectors",
         "entity_density_overlap", "formality", "lemma_overlap", "length_variance", "lexical_stats", "graph_sink", "macro_f1",
         "liwc_counts", "marker_flags", "metric_sink", "min_length_filter", "modal_ratio", "multi_skip_drift",
         "position_ratio", "punct_burstiness", "rhythm_pairs", "pattern_type", "pattern_blocks", "yules_k"]
RUN = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1] + "/kept").getOrCreate())
docs = [(1, "One cat, two dogs; three.\\nFour cats were seen five times!"), (2, "She sat.\\nSeven, eight.\\nWhy?"), (3, None),
        (4, "x"), (5, "The end.\\nMust it end?")]
spark.createDataFrame(docs, "doc_id long, text string").write.parquet(sys.argv[1] + "/documents.parquet")
vectors = [(k, k % 2, [float(k), 1.0, float(k * k)]) for k in range(8)]
spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(
    sys.argv[1] + "/embeddings.parquet")
import __spark_entry__ as entry
for name in sys.argv[3:]:
    try:
        found = entry.queries()[name](spark, sys.argv[1])
        print(name, found.count() if name in sys.argv[2].split(",") else len(found.columns))
    except Exception as e:
        print(name, type(e).__name__, str(e)[:200].replace("\\n", " "))
"""
COUNTED = {"length_variance": 8, "pattern_type": 8, "min_length_filter": 3, "position_ratio": 4, "embedding_pairs": 6,
           "embedding_vectors": 18}


def test_queries_run_in_a_plain_session(tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), ",".join(COUNTED), *NAMES], cwd=REPO,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    got = dict(line.split(" ", 1) for line in done.stdout.splitlines() if " " in line)
    assert set(got) >= set(NAMES)
    assert {n: got[n] for n in NAMES if not got[n].isdigit()} == {}
    assert {n: int(got[n]) for n in COUNTED} == COUNTED
