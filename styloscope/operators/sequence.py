"""Neighbour access and framed windows over ordered sentences, without a per-problem window.

``Window.partitionBy("problem_id")`` puts a whole problem in one task, so one huge problem stalls a
stage. Here every row is copied to the anchors whose frame contains it and the copies are grouped
on the composite key ``(problem_id, anchor)``: hash partitioning spreads a hot problem over all
tasks, and because neighbours usually sit in the same input partition (they were exploded from one
document row), the map-side partial aggregate shrinks the copies back to about one row per anchor
before the shuffle. Positions must be dense (0..n-1), as ``posexplode`` and ``sequence_index`` give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def offset_name(col: str, k: int) -> str:
    if k == 0:
        return col
    return f"{col}_next{'' if k == 1 else k}" if k > 0 else f"{col}_prev{'' if k == -1 else -k}"


def with_neighbours(df: DataFrame, keys: list[str], idx: str, cols: list[str], offsets: list[int],
                    keep: list[str] | None = None) -> DataFrame:
    """Add ``col_next``/``col_prev``/``col_next2``... (value at idx+k, null past the ends).

    ``keep`` are extra columns of the anchor row carried through unchanged.
    """
    keep = [c for c in (keep or []) if c not in cols]
    offs = [0] + [k for k in offsets if k != 0]
    ex = (df.select(*keys, idx, *cols, *keep)
          .withColumn("_off", F.explode(F.array(*[F.lit(k) for k in offs])))
          .withColumn("_anchor", F.col(idx) - F.col("_off")))
    aggs = [F.max((F.col("_off") == 0).cast("int")).alias("_self")]
    aggs += [F.first(F.when(F.col("_off") == 0, F.col(c)), ignorenulls=True).alias(c) for c in keep]
    for k in offs:
        for c in cols:
            aggs.append(F.first(F.when(F.col("_off") == k, F.col(c)), ignorenulls=True).alias(offset_name(c, k)))
    return (ex.groupBy(*keys, "_anchor").agg(*aggs)
            .filter(F.col("_self") == 1)
            .withColumnRenamed("_anchor", idx).drop("_self"))


def framed(df: DataFrame, keys: list[str], idx: str, lo: int, hi: int,
           aggs: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Aggregate each row's frame [idx+lo, idx+hi], truncated at the ends (rowsBetween(lo, hi)).

    ``aggs`` may refer to the columns of the input and to ``_off`` (the member's offset).
    """
    keep = keep or []
    offs = list(range(lo, hi + 1))
    ex = (df.withColumn("_off", F.explode(F.array(*[F.lit(k) for k in offs])))
          .withColumn("_anchor", F.col(idx) - F.col("_off")))
    allaggs = [F.max((F.col("_off") == 0).cast("int")).alias("_self")]
    allaggs += [F.first(F.when(F.col("_off") == 0, F.col(c)), ignorenulls=True).alias(c) for c in keep]
    return (ex.groupBy(*keys, "_anchor").agg(*allaggs, *aggs)
            .filter(F.col("_self") == 1)
            .withColumnRenamed("_anchor", idx).drop("_self"))
