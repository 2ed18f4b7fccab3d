"""Sentence explode, minimum-length filter, position ratio.

All three are per-problem-row work: the line array of a problem row is exploded with its size, so
no shuffle is needed to know how many sentences a problem has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloscope.functions.numeric import safe_div

MIN_SENTENCES = 2


def split_sentences(problems: DataFrame) -> DataFrame:
    """problems(problem_id, [difficulty], text) -> (problem_id, [difficulty], sent_idx, sentence, n_sentences)."""
    extra = [c for c in ("difficulty",) if c in problems.columns]
    lines = F.split(F.col("text"), "\n")
    return (problems
            .select("problem_id", *extra, F.size(lines).alias("n_sentences"),
                    F.posexplode(lines).alias("sent_idx", "sentence"))
            .select("problem_id", *extra, F.col("sent_idx").cast("int"), "sentence",
                    F.col("n_sentences").cast("int")))


def min_length_filter(sentences: DataFrame, min_n: int = MIN_SENTENCES) -> DataFrame:
    """Keep problems with at least ``min_n`` sentences."""
    return sentences.filter(F.col("n_sentences") >= min_n)


def pair_positions(sentences: DataFrame) -> DataFrame:
    """J1 keys + P10: one row per adjacent pair (i, i+1); position_ratio = i / max(1, n-1)."""
    s = min_length_filter(sentences)
    return (s.filter(F.col("sent_idx") < F.col("n_sentences") - 1)
            .select("problem_id", *[c for c in ("difficulty",) if c in s.columns],
                    F.col("sent_idx").alias("pair_idx"),
                    safe_div(F.col("sent_idx"), F.greatest(F.lit(1), F.col("n_sentences") - 1)).alias("position_ratio")))
