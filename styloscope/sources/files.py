"""Problem / truth / solution scans and the solution, graph and metric sinks.

Scans are single Spark reads over a folder tree (``recursiveFileLookup`` + ``pathGlobFilter``); the
problem id (a string, as ids may hold letters) and the difficulty come from each file's path
(``input_file_name``), so all three difficulties are one job and absent difficulty folders simply
contribute no rows. One file per problem is an input layout only; what is written here are record
files, as many as Spark has tasks, that carry the id as a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from styloscope.functions.text import strip_ws

ID_REGEX = r"problem-([0-9A-Za-z_]+)(?:\.[a-z]+)?(?:/[^/]*)?$"
DIFFICULTY_REGEX = r"/(?:difficulty=)?(easy|medium|hard)/"
CHANGES_SCHEMA = StructType([StructField("changes", ArrayType(IntegerType()))])


def _path_columns(path_col) -> list:
    pid = F.regexp_extract(path_col, ID_REGEX, 1)
    diff = F.regexp_extract(path_col, DIFFICULTY_REGEX, 1)
    return [F.when(pid != "", pid).alias("problem_id"),
            F.concat(F.lit("problem-"), pid).alias("problem_name"),
            F.when(diff == "", F.lit(None)).otherwise(diff).alias("difficulty")]


def read_problem_files(spark: SparkSession, root: str, pattern: str = "problem-*.txt") -> DataFrame:
    """(problem_id, problem_name, difficulty, text) -- one row per problem file, stripped."""
    df = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root))
    path = F.input_file_name()
    return df.select(*_path_columns(path), strip_ws("value").alias("text"))


def read_changes_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(problem_id, problem_name, difficulty, changes) from ``{"changes": [...]}`` files."""
    df = (spark.read.schema(CHANGES_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).json(root))
    return df.select(*_path_columns(F.input_file_name()), "changes")


def read_truth(spark: SparkSession, root: str) -> DataFrame:
    return read_changes_files(spark, root, "truth-problem-*.json")


def read_solution_files(spark: SparkSession, root: str) -> DataFrame:
    return read_changes_files(spark, root, "solution-problem-*.json")


def write_solutions(solutions: DataFrame, out: str) -> None:
    """One JSON record per problem (problem_id, changes), partitioned by difficulty."""
    solutions.select(F.col("problem_id").cast("string").alias("problem_id"), "changes", "difficulty").write.mode("overwrite").partitionBy("difficulty").json(out)


def read_solutions(spark: SparkSession, out: str) -> DataFrame:
    """Read back what ``write_solutions`` wrote; ids are strings, as file names give them (difficulty is the partition)."""
    schema = "problem_id string, changes array<int>, difficulty string"
    return spark.read.schema(schema).json(out).select("problem_id", "difficulty", "changes")


def write_problems(problems: DataFrame, out: str) -> None:
    """Problem texts as JSON records (problem_id, text) below difficulty=<d>."""
    (problems.select(F.col("problem_id").cast("string").alias("problem_id"), "text", "difficulty")
     .write.mode("overwrite").partitionBy("difficulty").json(out))


def read_problems(spark: SparkSession, out: str) -> DataFrame:
    """Read back what ``write_problems`` wrote: the columns of ``read_problem_files``, text stripped."""
    df = spark.read.schema("problem_id string, text string, difficulty string").json(out)
    return df.select("problem_id", F.concat(F.lit("problem-"), "problem_id").alias("problem_name"), "difficulty",
                     strip_ws("text").alias("text"))


def write_graphs(edges: DataFrame, out: str) -> None:
    """The edge table as Parquet partitioned by difficulty (keys included, nothing overwritten
    across problems)."""
    edges.write.mode("overwrite").partitionBy("difficulty").parquet(out)


def format_metrics(metrics: DataFrame) -> DataFrame:
    """S7 record format: ``measure{ key: "..." value: "..." }`` blocks (value "None" when null)."""
    v = F.coalesce(F.col("value").cast("string"), F.lit("None"))
    return metrics.select(F.format_string('measure{\n  key: "%s"\n  value: "%s"\n}', F.col("key"), v).alias("value"))


def write_metrics(metrics: DataFrame, out: str) -> None:
    """The (key, value) table as one text file (a handful of rows), replacing earlier output."""
    format_metrics(metrics).coalesce(1).write.mode("overwrite").text(out)


def read_metrics(spark: SparkSession, out: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "}\n").text(out)
    return blocks.select(F.regexp_extract("value", r'key: "([^"]*)"', 1).alias("key"),
                         F.regexp_extract("value", r'value: "([^"]*)"', 1).alias("value")).filter(F.col("key") != "")
