"""Input tables: the driver's parquet tables mapped onto problems, sentences, embeddings and truth.

Mapping (FIXTURES.md): a ``documents`` row is a problem and each of its lines a sentence;
``embeddings`` rows form problems by ``label`` ordered by ``vec_id``; change labels come from
*stitched* problems (four consecutive documents, all their lines, author = document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from styloscope.functions import lexicons as lx
from styloscope.functions.text import strip_ws

STITCH_DOCS = 4
#: The usual size of a Parquet row group, which is what one task reads at least.
ROW_GROUP_BYTES = 128 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` of a small input with its rows dealt out evenly to all cores.

    A file of one row group is one task however it is split, and what it writes is one file again. Only inputs of fewer
    files than cores, and of less than ROW_GROUP_BYTES a core, are dealt out; results do not depend on it.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    conf, total = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for f in files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(f))
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return df.repartition(cores) if total < cores * ROW_GROUP_BYTES else df


def difficulty_of(problem_id) -> "F.Column":
    """easy / medium / hard by problem id modulo 3 (fixture rule)."""
    return F.element_at(F.array(*[F.lit(d) for d in lx.DIFFICULTIES]), (problem_id % 3).cast("int") + 1)


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problems(problem_id, difficulty, text): one per document, text stripped."""
    docs = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("problem_id"),
                       difficulty_of(F.col("doc_id")).alias("difficulty"),
                       strip_ws("text").alias("text"))


def sequence_index(df: DataFrame, group_cols: list[str], order_col: str, out: str = "sent_idx",
                   bucket_width: int = 1 << 16) -> DataFrame:
    """Dense 0-based position of each row within its group, ordered by an integral unique column.

    Skew-safe two-level rank: rows are bucketed by ``order_col // bucket_width``; the row number
    inside a (group, bucket) is a window over at most ``bucket_width`` rows, and the bucket's offset
    is a running sum over per-bucket counts (one row per bucket). No task ever holds a whole group.
    """
    b = F.floor(F.col(order_col) / F.lit(bucket_width)).alias("_bucket")
    with_b = df.withColumn("_bucket", b)
    counts = with_b.groupBy(*group_cols, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*group_cols).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group_cols, "_bucket", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*group_cols, "_bucket").orderBy(order_col)
    ranked = with_b.withColumn("_rn", F.row_number().over(w_in) - 1)
    return (ranked.join(offsets, [*group_cols, "_bucket"])
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("int"))
            .drop("_bucket", "_off", "_rn"))


def embedding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(problem_id, sent_idx, embedding): label = problem, vec_id = order."""
    emb = read_table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("problem_id"), "vec_id", "embedding")
    return sequence_index(emb, ["problem_id"], "vec_id").drop("vec_id")


def stitched_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitched problems: problem_id = doc_id div 4; all lines of its documents in doc order.

    Returns (problem_id, difficulty, sent_idx, sentence, author, n_sentences). A line's position is its place in its
    document plus the line counts of the problem's earlier documents; only those counts, at most STITCH_DOCS
    numbers a problem, go through a window, never the lines.
    """
    docs = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.floor(F.col("doc_id") / STITCH_DOCS).cast("long").alias("problem_id"),
        F.split(strip_ws("text"), "\n").alias("lines"))
    counts = docs.select("problem_id", "doc_id", F.size("lines").alias("n"))
    before = Window.partitionBy("problem_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
                            F.sum("n").over(Window.partitionBy("problem_id")).cast("int").alias("n_sentences"))
    lines = docs.join(offsets, "doc_id").select(
        "problem_id", "doc_id", "offset", "n_sentences", F.posexplode("lines").alias("line_idx", "sentence"))
    return lines.select(
        "problem_id", difficulty_of(F.col("problem_id")).alias("difficulty"),
        (F.col("offset") + F.col("line_idx")).cast("int").alias("sent_idx"), "sentence",
        F.col("doc_id").alias("author"), "n_sentences")
