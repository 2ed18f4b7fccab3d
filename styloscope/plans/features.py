"""Feature tables composed from the operator families (the reference's feature-extraction entry).

``core_sentence_features``: families the SQL oracle reproduces (lexical, deep, pattern, graph counts).
``full_sentence_features``: + path centralities, dependency operators, contextual features.
``pair_feature_table``: the fixed-schema pair table with every pair-level family, smoothed and filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.functions import lexicons as lx
from styloscope.operators import pairs as pr
from styloscope.operators.annotated import annotate
from styloscope.operators.graph_arrays import TEXT, held
from styloscope.operators.graphs import graph_inputs
from styloscope.operators.tokens import normalize_sentences
from styloscope.session import store

KEY = ["problem_id", "sent_idx"]


def _graph_features(spark: SparkSession, sentences: DataFrame, with_paths: bool) -> DataFrame:
    """A stored row for each sentence that has a graph: its metrics; with paths the path summaries, the words that the graph
    is of and its closeness and eigenvector values per node too."""
    from styloscope.operators import adjacency as ad
    rows = graph_inputs(normalize_sentences(spark, sentences), KEY)
    if not with_paths:
        return store(ad.metrics(rows, KEY), "graph-metrics")
    from styloscope.operators.paths import centrality_rows
    measured = ad.metrics(rows, [*KEY, *TEXT]).withColumn("kept", F.struct(*TEXT))
    found = centrality_rows(measured, arrays=("closeness", "eigenvector"))
    return store(found.select("*", "kept.*").drop("kept"), "graph-metrics")


def _zero_fill(df: DataFrame, cols: list[str], keep_null: tuple[str, ...] = ("assortativity",)) -> DataFrame:
    """Sentences without a graph (fewer than two tokens) get 0 for every graph feature."""
    has = F.col("_has_graph").isNotNull()
    return df.select(*[c for c in df.columns if c not in cols and c != "_has_graph"],
                     *[F.when(has, F.col(c) if c in keep_null else F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
                       .otherwise(F.lit(0.0)).cast("double").alias(c) for c in cols])


def core_sentence_features(spark: SparkSession, sentences: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    from styloscope.operators.lexical import lexical_features
    from styloscope.operators.rhythm import pattern_blocks
    from styloscope.functions.text import pattern_flags

    graph = _graph_features(spark, sentences, with_paths=False) if graph is None else graph
    lex = store(lexical_features(sentences).select(*KEY, *pr.LEXICAL_FEATURES, *pr.DEEP_FEATURES,
                                                   "starts_with_discourse"), "lexical")
    pb = pattern_blocks(sentences)
    pb = store(pb.select("*", *pattern_flags("pattern_type")), "patterns")
    gm = graph.select(*KEY, *pr.GRAPH_COUNT_FEATURES, F.lit(1).alias("_has_graph"))
    base = sentences.select(*KEY).join(lex, KEY, "left").join(pb, KEY, "left").join(gm, KEY, "left")
    return _zero_fill(base, pr.GRAPH_COUNT_FEATURES)


def full_sentence_features(spark: SparkSession, sentences: DataFrame, embeddings: DataFrame,
                           graph: DataFrame | None = None) -> DataFrame:
    from styloscope.operators.context import entity_overlap, lemma_overlap
    from styloscope.operators.syntax import clause_complexity, dependency_depth, heuristic_parse, passive_ratio, \
        subject_overlap
    from styloscope.operators.vectors import neighbour_cosine, neighbour_vectors

    graph = _graph_features(spark, sentences, with_paths=True) if graph is None else graph
    core = core_sentence_features(spark, sentences, graph)
    parse = store(heuristic_parse(sentences), "parse")
    fams = [graph.select(*KEY, *pr.GRAPH_PATH_FEATURES), dependency_depth(parse), passive_ratio(parse),
            clause_complexity(parse), neighbour_cosine(neighbour_vectors(embeddings, (-1, 1))),
            entity_overlap(sentences), lemma_overlap(sentences), subject_overlap(parse, sentences)]
    out = core
    for f in fams:
        out = out.join(store(f, "family"), KEY, "left")
    fill = pr.GRAPH_PATH_FEATURES + pr.SYNTAX_FEATURES + [c for c in pr.CONTEXT_FEATURES if c != "starts_with_discourse"]
    return out.fillna(0.0, fill)


def pair_feature_table(spark: SparkSession, sentences: DataFrame, embeddings: DataFrame,
                       labels: DataFrame | None = None, with_drift: bool = True,
                       drift_paths: bool = True) -> DataFrame:
    """The full pair table (fixed schema), smoothed, NaN/inf/null -> 0, label last.

    Every family is written once in the shared folder, so no branch computes another's input again; smoothing reads
    its few key columns from the written table. ``drift_paths``: drift compares windows over all 30 graph features, path
    metrics among them (False: the 18 count features).
    """
    from styloscope.operators import adjacency as ad
    from styloscope.operators.paths import pair_values
    from styloscope.operators.pos import entropy_pairs, ngram_similarity, tfidf_cosine
    from styloscope.operators.rhythm import rhythm_pairs
    from styloscope.operators.sentences import pair_positions
    from styloscope.operators.vectors import directional_cosine, embedding_pairs, multi_skip_drift, neighbour_vectors

    sentences, embeddings = store(annotate(sentences), "annotated"), store(embeddings, "embeddings")
    graph = _graph_features(spark, sentences, with_paths=True)
    sent = store(full_sentence_features(spark, sentences, embeddings, graph), "sentence-features")
    nb = store(neighbour_vectors(embeddings, (1, 2, 3)), "neighbour-vectors")
    both = ("closeness", "eigenvector")
    extras = [
        ngram_similarity(sentences, "trigram"), ngram_similarity(sentences, "bigram"), tfidf_cosine(sentences),
        entropy_pairs(sentences), rhythm_pairs(sentences), embedding_pairs(nb), multi_skip_drift(nb),
        directional_cosine(nb),
        ad.pairwise(ad.with_next(pair_values(graph).select(*KEY, *held(graph), *both), both), both),
    ]
    if with_drift:
        from styloscope.operators.drift import wan_window_drift
        extras.append(wan_window_drift(spark, sentences, with_paths=drift_paths).select(
            "problem_id", F.col("wan_window_index").alias("pair_idx"),
            F.col("wan_window_cosine_sim").alias("wan_cosine_drift"),
            F.col("wan_window_euclidean").alias("wan_euclidean_drift")))
    extras = [store(e, "pair-family") for e in extras]
    table = store(pr.assemble_pairs(sent, pr.FULL_FEATURES, pair_positions(sentences), extras, labels), "pairs")
    keys = [k for k in lx.SMOOTH_KEYS if k in table.columns]
    smoothed = store(pr.smooth(table.select(*pr.PAIR_KEY, *keys), keys), "smoothed")
    table = table.join(smoothed, pr.PAIR_KEY, "left")
    return store(pr.label_last(pr.fill_numeric(table)), "pair-table")
