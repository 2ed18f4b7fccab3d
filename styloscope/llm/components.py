"""Connected components of a link table by contraction (DataFrame joins only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise

#: Each round follows 2^DOUBLINGS steps to lesser neighbours.
DOUBLINGS = 2
#: Rounds after which the labels so far are written, to keep the plan short.
ROUNDS_WRITTEN = 4


def _tidy(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b, once each."""
    return links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _moved(df: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """``df`` with the nodes in ``column`` replaced by where ``step`` (node, to) takes them."""
    named = step.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    return (df.join(named, F.col(column) == F.col("_node"), "left")
            .withColumn(column, F.coalesce("_to", column)).drop("_node", "_to"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node reachable.

    A round takes every node some steps down to its least neighbour's least neighbour and so on, and relabels the
    links with the nodes reached. The link between a node and its least neighbour survives as a link between their
    new labels, so nothing is lost, and a path shrinks to a fraction of its length. Minima are pre-aggregated, joins are
    plain equi-joins that adaptive execution splits at hot nodes, and the links of every round are written to the
    shared folder, which cuts the lineage.
    """
    links = materialise(_tidy(links), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    rounds = 0
    while not links.isEmpty():
        step = materialise(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")), "links-step")
        for _ in range(DOUBLINGS):
            step = _moved(step, "to", step)
        step = materialise(step, "links-step")
        labels = _moved(labels, "component", step)
        links = materialise(_tidy(_moved(_moved(links, "a", step), "b", step)), "links")
        rounds += 1
        if rounds % ROUNDS_WRITTEN == 0:
            labels = materialise(labels, "labels")
    return materialise(labels, "labels")
