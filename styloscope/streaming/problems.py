"""Incremental runs of the batch operators with Structured Streaming.

The reference processes a folder of problems in one go and keeps no state between problems, so a
stream needs no stateful operator: each problem arrives whole (a file or a table row), every
micro-batch runs the same DataFrame -> DataFrame operators through ``foreachBatch`` and writes to a
folder of its own, ``epoch=<id>``, replacing what a failed attempt left there: a retried batch counts
once. With the checkpoint folder of an earlier run, a query resumes where that run stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.functions.text import strip_ws
from styloscope.session import scratch_path
from styloscope.sources.tables import difficulty_of


def document_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The ``documents`` table, one file or a folder of part files, as a stream of problem rows (problem_id, difficulty,
    text)."""
    table = f"{sf_dir.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(table).schema
    # a stream takes a single file only by a pattern; this one matches the table's file or its folder
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{table[:-1]}[t]")
    return raw.select(F.col("doc_id").alias("problem_id"), difficulty_of(F.col("doc_id")).alias("difficulty"),
                      strip_ws("text").alias("text"))


def problem_file_stream(spark: SparkSession, root: str) -> DataFrame:
    """Problem files (``problem-*.txt`` anywhere under ``root``) as a stream of problem rows."""
    from styloscope.sources.files import ID_REGEX, DIFFICULTY_REGEX
    raw = (spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "problem-*.txt").load(root))
    path = F.input_file_name()
    return raw.select(F.regexp_extract(path, ID_REGEX, 1).alias("problem_id"),
                      F.regexp_extract(path, DIFFICULTY_REGEX, 1).alias("difficulty"), strip_ws("value").alias("text"))


def run_incremental(spark: SparkSession, stream: DataFrame, transform: Callable[[DataFrame], DataFrame],
                    out: str | None = None, name: str = "stream", checkpoint: str | None = None) -> str:
    """Apply ``transform`` (problems -> result rows) to every micro-batch, writing Parquet below
    ``out``/epoch=<id>; processes everything available, then stops. Returns the output path.

    ``out`` and ``checkpoint``: folders to go on from an earlier run; fresh ones in the shared folder by default.
    """
    out = out or scratch_path(spark, f"{name}-out")

    def batch(df: DataFrame, epoch_id: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    q = (stream.writeStream.foreachBatch(batch)
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
