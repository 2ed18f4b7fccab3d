"""G1-G9, G13-G21 and W9 on the row of a sentence: its graph as arrays, its metrics from them, no shuffle.

A graph is a struct: ``nodes``, sorted distinct names with their kind before them, words (0) before tags (1); ``edges``,
sorted distinct pairs (source, target) of node places packed in a long, loops left out; ``weights``, how often each edge
occurs; ``ends``, the first and last word and tag, where the graph of a neighbour can be joined on; and ``n_tokens``.
A text of one token has nodes here, as the window it is part of needs them, but no metrics and no rows of its own.

``joined`` gives the graph of consecutive texts from theirs: node sets are merged, places mapped, edge weights added and
the edges over the borders put in, so the tokens of a window are not gone through again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from styloscope.functions import arrays as ar
from styloscope.functions.arrays import high, let, lets, low, pack, total, upto
from styloscope.functions.numeric import safe_div
from styloscope.operators import graph_arrays as ga
from styloscope.operators.graphs import POS_PREFIX, graph_inputs
from styloscope.operators.sequence import with_neighbours
from styloscope.operators.tokens import normalize_sentences

KEY = ["problem_id", "sent_idx"]
WORD, TAG = "0", "1"


def _named(names: Column, kind: str) -> Column:
    return F.transform(names, lambda w: F.concat(F.lit(kind), w))


def is_tag(node: Column) -> Column:
    return F.startswith(node, F.lit(TAG))


def _counted(codes: Column) -> Column:
    """struct(edges, weights) of pairs with repeats; loops go."""
    ordered = F.sort_array(F.filter(codes, lambda c: high(c) != low(c)))
    return let(ordered, lambda s: F.struct(
        F.transform(ar.run_heads(s), lambda at: F.get(s, at)).alias("edges"), ar.run_lengths(s).alias("weights")))


def graph_of(words: Column, tags: Column, with_tags: Column) -> Column:
    """The graph of a text's normalised words and their tags (without tag nodes unless ``with_tags``)."""
    none = F.array().cast("array<string>")

    def build(w: Column, t: Column) -> Column:
        def of(r: Column) -> Column:
            n = F.size(w)
            steps = F.filter(upto(F.size(r["ids"]) - 1), lambda i: i != n - 1)  # not from the last word to the first tag
            codes = F.transform(steps, lambda i: pack(F.get(r["ids"], i), F.get(r["ids"], i + 1)))
            ends = F.struct(F.get(w, F.lit(0)).alias("first_word"), F.get(w, n - 1).alias("last_word"),
                            F.get(t, F.lit(0)).alias("first_tag"), F.get(t, F.size(t) - 1).alias("last_tag"))
            return let(_counted(codes), lambda c: F.struct(
                r["nodes"].alias("nodes"), c["edges"].alias("edges"), c["weights"].alias("weights"), ends.alias("ends"),
                n.alias("n_tokens")))

        return let(ar.ranked(F.concat(_named(w, WORD), _named(t, TAG))), of)

    return lets([words, F.when(with_tags, tags).otherwise(none)], build)


def joined(graphs: Column) -> Column:
    """The graph of consecutive texts from the graphs of the texts (an array); texts without tokens are passed over."""
    def build(g: Column) -> Column:
        nodes = F.sort_array(F.array_distinct(F.flatten(F.transform(g, lambda x: x["nodes"]))))

        def over(all_nodes: Column) -> Column:
            def place(kind: str, name: Column) -> Column:
                return F.array_position(all_nodes, F.concat(F.lit(kind), name)) - 1

            def border(i: Column) -> Column:
                left, right = F.get(g, i)["ends"], F.get(g, i + 1)["ends"]
                word = F.array(pack(place(WORD, left["last_word"]), place(WORD, right["first_word"])))
                tag = F.when(left["last_tag"].isNotNull() & right["first_tag"].isNotNull(),
                             F.array(pack(place(TAG, left["last_tag"]), place(TAG, right["first_tag"]))))
                return F.concat(word, F.coalesce(tag, F.array().cast("array<bigint>")))

            moved = F.flatten(F.transform(g, lambda x: let(ar.matched(x["nodes"], all_nodes), lambda at: F.flatten(
                F.zip_with(x["edges"], x["weights"], lambda e, n: F.array_repeat(
                    pack(F.get(at, high(e)), F.get(at, low(e))), n))))))
            borders = F.flatten(F.transform(upto(F.size(g) - 1), border))
            first, last = F.get(g, F.lit(0))["ends"], F.get(g, F.size(g) - 1)["ends"]
            ends = F.struct(first["first_word"].alias("first_word"), last["last_word"].alias("last_word"),
                            first["first_tag"].alias("first_tag"), last["last_tag"].alias("last_tag"))
            return let(_counted(F.concat(moved, borders)), lambda c: F.struct(
                all_nodes.alias("nodes"), c["edges"].alias("edges"), c["weights"].alias("weights"), ends.alias("ends"),
                total(F.transform(g, lambda x: x["n_tokens"]), "int").alias("n_tokens")))

        return let(nodes, over)

    return let(F.filter(graphs, lambda x: x["n_tokens"] > 0), build)


def _squares(values: Column) -> Column:
    return total(F.transform(values, lambda x: x.cast("long") * x))


#: The metrics of each family, in order.
FAMILY_COLUMNS = {
    "degree": ["V", "E", "average_degree", "density", "degree_centrality_mean", "degree_centrality_std",
               "degree_centrality_max", "degree_centrality_min", "in_degree_mean", "in_degree_std", "out_degree_mean",
               "out_degree_std", "star_ratio", "pos_node_count", "pos_avg_degree", "pos_density", "pos_centrality_mean",
               "pos_centrality_std", "degree_entropy"],
    "assortativity": ["assortativity"],
    "clustering": ["average_clustering", "triangle_count"],
    "transition": ["pos_transition_entropy", "pos_transition_entropy_weighted"],
}
COUNTS = {"V", "E", "pos_node_count", "triangle_count"}
FAMILIES = tuple(FAMILY_COLUMNS)


def metrics(rows: DataFrame, keys: list[str], families: tuple[str, ...] = FAMILIES, every_row: bool = False) -> DataFrame:
    """(keys, metrics of the ``families``) of every row whose graph has two tokens or more; ``rows`` have the ``graph`` or
    the words that it is of (``graph_inputs``).

    With ``every_row`` the other rows stay, with null metrics. A row in, a row out: the graphs of a batch are measured
    together (``graph_arrays``), without an exchange.
    """
    columns = {c: pa.int64() if c in COUNTS else pa.float64() for f in families for c in FAMILY_COLUMNS[f]}

    def measure(g: ga.Graphs) -> dict[str, object]:
        found, (out, into) = {}, g.degrees()
        for family in families:
            found |= {"degree": lambda: ga.degree_values(g, out, into), "clustering": lambda: ga.clustering_values(g),
                      "assortativity": lambda: ga.assortativity_values(g, out, into),
                      "transition": lambda: ga.transition_values(g)}[family]()
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from ga.measured(batch, columns, every_row, measure)

    added = [StructField(c, LongType() if c in COUNTS else DoubleType()) for c in columns]
    return rows.select(*keys, ga.packed(rows).alias("_g")).mapInArrow(
        run, StructType(rows.select(*keys).schema.fields + added))


def graph_rows(norm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, graph) from (keys, words, tags, include_pos), a row for every text."""
    return norm.select(*keys, graph_of(F.col("words"), F.col("tags"), F.col("include_pos")).alias("graph"))


def sentence_graphs(spark: SparkSession, sentences: DataFrame, preset: str | None = None,
                    annotations: DataFrame | None = None) -> DataFrame:
    """(problem_id, sent_idx, graph) of every sentence under its problem's preset (or a fixed one), from the built-in
    annotator or a caller's ``annotations`` (the ``tokens`` table)."""
    return graph_rows(graph_inputs(normalize_sentences(spark, sentences, preset, annotations), KEY), KEY)


def edge_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """G1-G3 as rows: keys, src, dst, weight, edge_type of every edge (graphs of two tokens or more)."""
    name = lambda node: F.substr(node, F.lit(2))

    def of(g: Column) -> Column:
        return F.when(g["n_tokens"] >= 2, F.transform(g["edges"], lambda e, k: F.struct(
            name(F.get(g["nodes"], high(e))).alias("src"), name(F.get(g["nodes"], low(e))).alias("dst"),
            F.get(g["weights"], k).cast("long").alias("weight"),
            F.when(is_tag(F.get(g["nodes"], high(e))), "pos_pos").otherwise("word").alias("edge_type"))))

    return rows.select(*keys, F.inline(let(F.col("graph"), of)))


def node_table(norm: DataFrame, keys: list[str]) -> DataFrame:
    """G2 as rows: keys, node, node_type, pos of every node, from (keys, words, tags, include_pos).

    ``pos`` is the tag of a word's last occurrence (null without tag nodes, and for these themselves): the words are sorted
    with their places, and the last entry of each run has it.
    """
    def of(w: Column, t: Column, with_tags: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"), F.get(t, i).alias("t"))))

        def words(s: Column, h: Column) -> Column:
            last = lambda k: F.get(s, F.coalesce(F.get(h, k + 1), F.size(s)) - 1)
            return F.transform(h, lambda at, k: F.struct(
                F.get(s, at)["w"].alias("node"), F.lit("word").alias("node_type"),
                F.when(with_tags, F.substr(last(k)["t"], F.lit(len(POS_PREFIX) + 1))).alias("pos")))

        tags = F.transform(F.array_distinct(t), lambda x: F.struct(
            x.alias("node"), F.lit("POS").alias("node_type"), F.lit(None).cast("string").alias("pos")))
        found = let(placed, lambda s: let(ar.run_heads(F.transform(s, lambda x: x["w"])), lambda h: words(s, h)))
        return F.when(F.size(w) >= 2, F.when(with_tags, F.concat(found, tags)).otherwise(found))

    return norm.select(*keys, F.inline(lets([F.col("words"), F.col("tags"), F.col("include_pos")], of)))


def with_next(rows: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """Graph rows (with the ``graph`` or its words) with the next sentence's graph and ``values`` (``graph_next``, ...; null
    for the last sentence)."""
    return with_neighbours(rows, ["problem_id"], "sent_idx", [*ga.held(rows), *values], [1])


def pairwise(rows: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """G21, G22 for adjacent sentences whose graphs are both non-empty, on the row of the pair.

    ``rows`` is ``with_next``'s result. Degree centralities are integers over V - 1, a factor that a cosine does not see.
    Each of ``values`` is an array with a number for each node and adds ``<name>_cosine``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from ga.compared(batch, 2, values)

    keys = rows.select("problem_id", F.col("sent_idx").alias("pair_idx"))
    names = ["edge_jaccard", "node_jaccard", "centrality_cosine", *[f"{v}_cosine" for v in values]]
    return rows.select("problem_id", F.col("sent_idx").alias("pair_idx"), ga.packed(rows).alias("_a"),
                       ga.packed(rows, "_next").alias("_b"), *[c for v in values for c in (v, f"{v}_next")]).mapInArrow(
        run, StructType(keys.schema.fields + [StructField(n, DoubleType()) for n in names]))
