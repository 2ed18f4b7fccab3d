"""Helpers shared by the training-data operators: reading tables, shared files, Arrow streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.session import ensure_checkpoint_dir, scratch_path
from styloscope.sources.tables import read_table

__all__ = ["read_table", "scratch_path", "prepare", "materialise", "stream", "shuffle_partitions", "lower_ascii",
           "held_out"]

#: Rows per Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings the operators need: a checkpoint folder and small Arrow batches."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts lineage, survives lost executors)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # an empty partitioned table leaves no file to read one from


def stream(df: DataFrame, schema: str, rows: Callable[..., Iterator[tuple]], per_batch: int = 8192) -> DataFrame:
    """Arrow-streamed map: ``rows(batches)`` takes an iterator of column-list tuples and yields output tuples.

    Output tuples are packed into record batches of at most ``per_batch`` rows, so memory stays bounded by
    one input batch and one output batch whatever the partition size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*buffer))
            buffer.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        columns = (tuple(c.to_pylist() for c in b.columns) for b in batches)
        for row in rows(columns):
            buffer.append(row)
            if len(buffer) >= per_batch:
                yield flush()
        if buffer:
            yield flush()

    return df.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``, equals ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
