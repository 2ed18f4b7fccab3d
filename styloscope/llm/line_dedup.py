"""Operator 2: line dedup by overlapping three-line windows (DataFrame functions only).

Every run of three consecutive lines is hashed (128 bits, lines trimmed of spaces). A window stays where it occurs
first, in order of doc_id and position; every later occurrence covers its three lines, covered positions are merged
and those lines are removed.

Within a document the repeats are found in its row. Across documents only (hash, doc_id) pairs are shuffled: least
and greatest doc_id per hash are pre-aggregated in the map tasks, and only hashes of more than one document are
joined back. A window that a third of all documents share is one row per map task before the shuffle, and its
occurrences form a partition that adaptive execution splits.

Edge cases: null texts stay null and texts of fewer than three lines stay as they are; windows of three blank lines
never match; a document whose lines are all repeats stays as a row with an empty text; null doc_ids come first; rows
with one doc_id count as one document, so a window that they share is not removed for that reason; an empty table
gives no rows; columns of any name are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.quality import let

LINES = 3
SPACES = " \t\x0b\f\r"


def window_pairs(lines: Column) -> Column:
    """Sorted structs (h, g, p): two 64-bit hashes of the window that starts at line p."""
    n = F.size(lines) - (LINES - 1)
    hashed = F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))
    def windows(trimmed: Column) -> Column:
        shifted = [F.slice(trimmed, k + 1, n) for k in range(LINES)]
        return F.transform(F.arrays_zip(*shifted), lambda w, p: F.struct(
            F.xxhash64(w).alias("h"), F.xxhash64(F.lit(1), w).alias("g"), p.cast("int").alias("p"),
            (F.concat(*[w[str(k)] for k in range(LINES)]) == "").alias("blank")))
    pairs = F.filter(let(hashed, windows), lambda x: ~x["blank"])
    return F.when(n > 0, F.array_sort(pairs)).otherwise(F.array_sort(F.slice(pairs, 1, 0)))


def with_windows(docs: DataFrame) -> DataFrame:
    """row, doc (null id: least), print (hash of the text), lines, pairs."""
    text = F.coalesce("text", F.lit(""))
    return (docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc"),
                        F.xxhash64(text).alias("print"), F.split(text, "\n").alias("lines"))
            .withColumn("pairs", F.when(F.size("lines") < LINES, F.array().cast(
                "array<struct<h:bigint,g:bigint,p:int,blank:boolean>>")).otherwise(window_pairs(F.col("lines")))))


def _first(pair: Column, k: Column) -> Column:
    """Whether sorted pair number k opens a run of equal hashes."""
    before = F.get(F.col("pairs"), k - 1)
    return (k == 0) | (before["h"] != pair["h"]) | (before["g"] != pair["g"])


def repeated_elsewhere(docs: DataFrame) -> DataFrame:
    """Per row (doc, print): starts of the windows that an earlier document has."""
    first = F.filter("pairs", _first)
    occurrences = (with_windows(docs).select("doc", "print", F.inline(first)).drop("blank"))
    shared = (occurrences.groupBy("h", "g").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
              .filter("least < most").select("h", "g", "least"))
    later = occurrences.join(shared, ["h", "g"]).filter("doc > least")
    return later.groupBy("doc", "print").agg(F.collect_set("p").alias("elsewhere"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The input columns with repeated windows cut from ``text``, and n_lines, removed (sorted line numbers)."""
    every = with_windows(docs)
    again = F.transform(F.filter("pairs", lambda x, k: ~_first(x, k)), lambda x: x["p"])
    starts = F.concat(again, F.coalesce("elsewhere", F.array().cast("array<int>")))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (LINES - 1)))))
    joined = (every.join(repeated_elsewhere(docs), ["doc", "print"], "left")
              .select("row", "lines", covered.alias("covered")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    # the lambda must read a stored array, not split the text again for every line
    text = F.when(F.size("covered") == 0, F.col("row.text")).otherwise(
        F.array_join(F.transform(left, lambda k: F.get(F.col("lines"), k)), "\n"))
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(F.struct(*columns).alias("row"), F.size("lines").alias("n_lines"),
                         F.array_sort("covered").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its own columns, repeated windows cut from ``text``."""
    return dedup_lines(docs).select("row.*")
