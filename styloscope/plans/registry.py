"""Registered queries: name -> (spark, sf_dir) -> DataFrame, over the driver's whole tables.

Every query starts from the given parquet tables; nothing is sampled, capped or prefixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.functions.text import pattern_flags
from styloscope.operators import rhythm as rh
from styloscope.operators import sentences as se
from styloscope.operators.annotated import annotate
from styloscope.plans.common import finalize
from styloscope.session import configure, store
from styloscope.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: finalize(fn(configure(spark), sf_dir))
        QUERIES[name].__name__ = name
        return fn
    return deco


def _sentences(spark, sf_dir):
    return se.split_sentences(tb.problems(spark, sf_dir))


# --- P1, P2, P10 -----------------------------------------------------------------------------

@query("sentence_split")
def q_sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir).select("problem_id", "sent_idx", "sentence", "n_sentences")


@query("min_length_filter")
def q_min_length_filter(spark, sf_dir):
    p = tb.problems(spark, sf_dir)
    return (p.select("problem_id", F.size(F.split("text", "\n")).cast("int").alias("n_sentences"))
            .filter(F.col("n_sentences") >= se.MIN_SENTENCES))


@query("position_ratio")
def q_position_ratio(spark, sf_dir):
    return se.pair_positions(_sentences(spark, sf_dir)).select("problem_id", "pair_idx", "position_ratio")


# --- W1, W2, V15, T1, T2, W4 ------------------------------------------------------------------

@query("punct_burstiness")
def q_punct_burstiness(spark, sf_dir):
    return rh.rhythm_of_problems(tb.problems(spark, sf_dir)).select("problem_id", "sent_idx", "punctuation_burstiness")


@query("length_variance")
def q_length_variance(spark, sf_dir):
    return rh.rhythm_of_problems(tb.problems(spark, sf_dir)).select("problem_id", "sent_idx", "length_variance")


@query("rhythm_pairs")
def q_rhythm_pairs(spark, sf_dir):
    return rh.rhythm_pairs_of_problems(tb.problems(spark, sf_dir))


@query("pattern_type")
def q_pattern_type(spark, sf_dir):
    from styloscope.functions.text import pattern_type
    s = _sentences(spark, sf_dir).select("problem_id", "sent_idx", pattern_type("sentence").alias("pattern_type"))
    return s.select("*", *pattern_flags("pattern_type"))


@query("pattern_blocks")
def q_pattern_blocks(spark, sf_dir):
    return rh.pattern_blocks(_sentences(spark, sf_dir))


# --- A1-A13, T3-T15 (lexical family) ---------------------------------------------------------

def _lexical(spark, sf_dir):
    from styloscope.operators.lexical import lexical_features
    return lexical_features(_sentences(spark, sf_dir))


def _lex_query(name, cols):
    @query(name)
    def fn(spark, sf_dir):
        return _lexical(spark, sf_dir).select("problem_id", "sent_idx", *cols)
    return fn


LEXICAL_QUERIES = {
    "lexical_stats": ["ttr", "avg_word_len", "sentence_char_len", "sentence_token_len", "char_per_token"],
    "yules_k": ["yules_k"],
    "char_ratios": ["char_alpha_ratio", "char_upper_ratio", "char_digit_ratio", "repeated_punct", "markdown_emphasis"],
    "marker_flags": ["discourse_marker_ratio", "sarcasm_marker", "has_emoji", "has_non_ascii", "has_quoted_text",
                     "starts_with_discourse"],
    "rhetorical_caps": ["rhetorical_question", "has_all_caps", "all_caps_words"],
    "person_ratios": ["first_person_ratio", "second_person_ratio", "third_person_ratio"],
    "stopword_ratio": ["stopword_ratio"],
    "wh_word_ratio": ["wh_word_ratio"],
    "liwc_counts": ["liwc_analytic_count", "liwc_affective_count", "liwc_authenticity_count", "liwc_certainty_count",
                    "liwc_tentativeness_count"],
    "readability": ["flesch_reading_ease", "gunning_fog", "automated_readability_index", "syllable_count",
                    "dale_chall_score"],
    "sentiment": ["sentiment_polarity", "subjectivity_score"],
    "pos_ratios": ["function_word_ratio", "pronoun_ratio", "conjunction_ratio", "preposition_ratio"],
    "formality": ["formality_score"],
    "modal_ratio": ["modal_word_ratio"],
}
for _n, _c in LEXICAL_QUERIES.items():
    _lex_query(_n, _c)

from styloscope.plans import oracle as _oracle  # noqa: E402

_oracle.register_lexical(LEXICAL_QUERIES)


# --- A16, A17, V9-V11, A12, W6, W7 ------------------------------------------------------------

@query("pos_ngrams")
def q_pos_ngrams(spark, sf_dir):
    from styloscope.operators.pos import ngram_counts
    s = _sentences(spark, sf_dir)
    return (ngram_counts(s, 2, 0).withColumn("kind", F.lit("bigram"))
            .unionByName(ngram_counts(s, 2, 1).withColumn("kind", F.lit("skipgram")))
            .select("problem_id", "sent_idx", "kind", "ngram", "cnt"))


@query("pos_entropy")
def q_pos_entropy(spark, sf_dir):
    from styloscope.operators.pos import pos_entropy
    return pos_entropy(_sentences(spark, sf_dir))


@query("pos_entropy_pairs")
def q_pos_entropy_pairs(spark, sf_dir):
    from styloscope.operators.pos import entropy_pairs
    return entropy_pairs(_sentences(spark, sf_dir))


@query("pos_tfidf_cosine")
def q_pos_tfidf_cosine(spark, sf_dir):
    from styloscope.operators.pos import tfidf_cosine
    return tfidf_cosine(_sentences(spark, sf_dir))


@query("pos_ngram_similarity")
def q_pos_ngram_similarity(spark, sf_dir):
    from styloscope.operators.pos import ngram_similarity
    s = _sentences(spark, sf_dir)
    return ngram_similarity(s, "bigram").join(ngram_similarity(s, "trigram"), ["problem_id", "pair_idx"])


@query("entity_density_overlap")
def q_entity_density_overlap(spark, sf_dir):
    from styloscope.operators.context import entity_overlap
    s = _sentences(spark, sf_dir)
    return _lexical(spark, sf_dir).select("problem_id", "sent_idx", "ner_density").join(
        entity_overlap(s), ["problem_id", "sent_idx"])


@query("lemma_overlap")
def q_lemma_overlap(spark, sf_dir):
    from styloscope.operators.context import lemma_overlap
    return lemma_overlap(_sentences(spark, sf_dir))


# --- G1-G9, G13-G22 (word adjacency networks) ------------------------------------------------

def _wan(spark, sf_dir):
    from styloscope.operators.adjacency import sentence_graphs
    return sentence_graphs(spark, _sentences(spark, sf_dir))


def _wan_words(spark, sf_dir):
    """The sentences' words and tags, which metrics and comparisons make their graphs of."""
    from styloscope.operators.graphs import graph_inputs
    from styloscope.operators.tokens import normalize_sentences
    return graph_inputs(normalize_sentences(spark, _sentences(spark, sf_dir)), ["problem_id", "sent_idx"])


@query("wan_edges")
def q_wan_edges(spark, sf_dir):
    from styloscope.operators import adjacency as ad
    return ad.edge_table(_wan(spark, sf_dir), ad.KEY)


@query("wan_nodes")
def q_wan_nodes(spark, sf_dir):
    from styloscope.operators import adjacency as ad
    from styloscope.operators.graphs import graph_inputs
    from styloscope.operators.tokens import normalize_sentences
    return ad.node_table(graph_inputs(normalize_sentences(spark, _sentences(spark, sf_dir)), ad.KEY), ad.KEY)


WAN_QUERIES = {
    "wan_global": ["V", "E", "average_degree", "density"],
    "wan_degree": ["degree_centrality_mean", "degree_centrality_std", "degree_centrality_max",
                   "degree_centrality_min", "in_degree_mean", "in_degree_std", "out_degree_mean", "out_degree_std"],
    "wan_clustering": ["average_clustering"],
    "wan_assortativity": ["assortativity"],
    "wan_entropy": ["degree_entropy", "pos_transition_entropy", "pos_transition_entropy_weighted"],
    "wan_star_triangles": ["triangle_count", "star_ratio"],
    "wan_pos": ["pos_node_count", "pos_avg_degree", "pos_density", "pos_centrality_mean", "pos_centrality_std"],
}


#: The metric families of a query whose columns do not all belong to the degree family.
WAN_FAMILIES = {"wan_clustering": ("clustering",), "wan_assortativity": ("assortativity",),
                "wan_entropy": ("degree", "transition"), "wan_star_triangles": ("degree", "clustering")}


def _wan_query(name, cols):
    @query(name)
    def fn(spark, sf_dir):
        from styloscope.operators import adjacency as ad
        found = ad.metrics(_wan_words(spark, sf_dir), ad.KEY, WAN_FAMILIES.get(name, ("degree",)))
        return found.select("problem_id", "sent_idx", *cols)
    return fn


for _n, _c in WAN_QUERIES.items():
    _wan_query(_n, _c)


@query("wan_pairwise")
def q_wan_pairwise(spark, sf_dir):
    from styloscope.operators import adjacency as ad
    return ad.pairwise(ad.with_next(_wan_words(spark, sf_dir)))


_oracle.register_wan(WAN_QUERIES)


# --- V1-V6, W5, W10, W11 (embeddings) -------------------------------------------------------

def _emb_nb(spark, sf_dir, *offsets):
    from styloscope.operators.vectors import neighbour_vectors
    return neighbour_vectors(tb.embedding_sentences(spark, sf_dir), offsets)


@query("embedding_pairs")
def q_embedding_pairs(spark, sf_dir):
    from styloscope.operators.vectors import embedding_pairs
    return embedding_pairs(_emb_nb(spark, sf_dir, 1))


@query("embedding_vectors")
def q_embedding_vectors(spark, sf_dir):
    from styloscope.operators.vectors import vector_pairs
    pairs = vector_pairs(_emb_nb(spark, sf_dir, 1))
    return (pairs.select("problem_id", "pair_idx", F.posexplode(F.arrays_zip("f1_sbert", "f2_sbert", "delta_sbert"))
                         .alias("dim", "v"))
            .select("problem_id", "pair_idx", "dim", "v.f1_sbert", "v.f2_sbert", "v.delta_sbert"))


@query("multi_skip_drift")
def q_multi_skip_drift(spark, sf_dir):
    from styloscope.operators.vectors import multi_skip_drift
    return multi_skip_drift(_emb_nb(spark, sf_dir, 1, 2, 3))


@query("directional_cosine")
def q_directional_cosine(spark, sf_dir):
    from styloscope.operators.vectors import directional_cosine
    return directional_cosine(_emb_nb(spark, sf_dir, 1, 2))


@query("neighbor_cosine")
def q_neighbor_cosine(spark, sf_dir):
    from styloscope.operators.vectors import neighbour_cosine
    return neighbour_cosine(_emb_nb(spark, sf_dir, -1, 1))


@query("embedding_pca")
def q_embedding_pca(spark, sf_dir):
    from styloscope.operators.vectors import pca_reduce
    from styloscope.functions.numeric import norm
    # the sign of a component is arbitrary, so the squares and the length are shown
    return pca_reduce(tb.embedding_sentences(spark, sf_dir)).select(
        "problem_id", "sent_idx", norm("pca").alias("length"),
        *[F.pow(F.get("pca", F.lit(k)), 2).alias(f"square_{k}") for k in range(8)])


# --- G10-G12 path and spectral metrics (kernel per graph; no SQL oracle) ---------------------

def _path_query(name, metric):
    @query(name)
    def fn(spark, sf_dir):
        from styloscope.operators.paths import centrality_rows
        cols = [f"{metric}_centrality_{x}" for x in ("mean", "std", "max", "min")]
        extra = ["eigenvector_converged"] if metric == "eigenvector" else []
        found = centrality_rows(_wan_words(spark, sf_dir), (metric,)).filter(F.col(cols[0]).isNotNull())
        return found.select("problem_id", "sent_idx", *cols, *extra)
    return fn


for _m in ("closeness", "betweenness", "eigenvector"):
    _path_query(f"wan_{_m}", _m)


@query("wan_path_pairwise")
def q_wan_path_pairwise(spark, sf_dir):
    from styloscope.operators import adjacency as ad
    from styloscope.operators import graph_arrays as ga
    from styloscope.operators.paths import centrality_rows, pair_values
    both = ("closeness", "eigenvector")
    words = _wan_words(spark, sf_dir)
    rows = centrality_rows(words.withColumn("kept", F.struct(*ga.TEXT)), both, both)
    rows = pair_values(rows).select("*", "kept.*")
    return ad.pairwise(ad.with_next(rows, both), both).select("problem_id", "pair_idx", "closeness_cosine",
                                                              "eigenvector_cosine")


# --- A14, A18, A19, W8 (dependency operators over the built-in rule parse) -------------------

def _parse(spark, sf_dir):
    from styloscope.operators.syntax import heuristic_parse
    s = _sentences(spark, sf_dir)
    return s, store(heuristic_parse(s), "parse")


def _per_sentence(s, df, col):
    return s.select("problem_id", "sent_idx").join(df, ["problem_id", "sent_idx"], "left").select(
        "problem_id", "sent_idx", F.coalesce(F.col(col), F.lit(0.0)).alias(col))


@query("dep_depth")
def q_dep_depth(spark, sf_dir):
    from styloscope.operators.syntax import dependency_depth
    s, p = _parse(spark, sf_dir)
    return _per_sentence(s, dependency_depth(p), "dependency_avg_depth")


@query("passive_ratio")
def q_passive_ratio(spark, sf_dir):
    from styloscope.operators.syntax import passive_ratio
    s, p = _parse(spark, sf_dir)
    return _per_sentence(s, passive_ratio(p), "passive_ratio")


@query("clause_ratio")
def q_clause_ratio(spark, sf_dir):
    from styloscope.operators.syntax import clause_complexity
    s, p = _parse(spark, sf_dir)
    return _per_sentence(s, clause_complexity(p), "clause_complexity")


@query("subject_overlap")
def q_subject_overlap(spark, sf_dir):
    from styloscope.operators.syntax import subject_overlap
    s, p = _parse(spark, sf_dir)
    return subject_overlap(p, s)


# --- J1, J3, V7, V8, V12-V14, P6-P10, W3 (pair assembly over the core families) --------------

def _core_pairs(spark, sf_dir, extra_cols=(), wanted=()):
    """The stored pair table of the core families and ``extra_cols``; of the ``wanted`` columns only, if any are named."""
    from styloscope.operators import pairs as pr
    from styloscope.operators.sentences import pair_positions
    from styloscope.plans.features import core_sentence_features
    s = store(annotate(_sentences(spark, sf_dir)), "annotated")
    sent = core_sentence_features(spark, s)
    cols = list(pr.CORE_FEATURES)
    if extra_cols:
        from styloscope.operators.syntax import clause_complexity, heuristic_parse
        sent = sent.join(clause_complexity(heuristic_parse(s)), ["problem_id", "sent_idx"], "left").fillna(
            0.0, ["clause_complexity"])
        cols += list(extra_cols)
    sent = store(sent, "sentence-features")
    pairs = pr.assemble_pairs(sent, cols, pair_positions(s)).drop("label")
    return store(pr.fill_numeric(pairs.select(*pr.PAIR_KEY, *wanted) if wanted else pairs), "pairs")


@query("pair_features")
def q_pair_features(spark, sf_dir):
    return _core_pairs(spark, sf_dir)


@query("pair_row_similarity")
def q_pair_row_similarity(spark, sf_dir):
    return _core_pairs(spark, sf_dir, ("clause_complexity",),
                       ("cosine_similarity", "euclidean_distance", "deep_style_cosine"))


@query("smooth_features")
def q_smooth_features(spark, sf_dir):
    from styloscope.operators import pairs as pr
    from styloscope.operators.pos import ngram_similarity
    p = _core_pairs(spark, sf_dir, ("clause_complexity",), ("cosine_similarity", "deep_style_cosine"))
    p = p.join(ngram_similarity(_sentences(spark, sf_dir), "trigram"), pr.PAIR_KEY, "left")
    return pr.smooth(p, ["cosine_similarity", "deep_style_cosine", "pos_trigram_cosine"])


# --- S9, P4, P5 (presets and the sentence normaliser) ----------------------------------------

@query("preset_lookup")
def q_preset_lookup(spark, sf_dir):
    from styloscope.operators.tokens import with_preset
    p = tb.problems(spark, sf_dir).select("problem_id", "difficulty")
    return with_preset(spark, p).select("problem_id", "difficulty", "preset", "remove_punct", "remove_stopwords",
                                        "lemmatize", "include_pos")


@query("normalize_sentence")
def q_normalize_sentence(spark, sf_dir):
    from styloscope.operators.tokens import normalize_sentences
    n = normalize_sentences(spark, _sentences(spark, sf_dir))
    return n.select("problem_id", "sent_idx", "preset", F.array_join("norm_tokens", " ").alias("normalized"))


# --- J5, J7, A20, A21, M1-M5 (labels, evaluation, model) --------------------------------------

def _truth(spark, sf_dir):
    from styloscope.operators.evaluate import author_change_labels, collect_changes
    return collect_changes(author_change_labels(tb.stitched_sentences(spark, sf_dir)), "label", extra=["difficulty"])


@query("change_labels")
def q_change_labels(spark, sf_dir):
    from styloscope.operators.evaluate import explode_changes
    return explode_changes(_truth(spark, sf_dir)).select("problem_id", "pair_idx", "label")


@query("macro_f1")
def q_macro_f1(spark, sf_dir):
    from styloscope.operators.evaluate import collect_changes, macro_f1, relative_length_predictor
    sol = collect_changes(relative_length_predictor(tb.stitched_sentences(spark, sf_dir)), "y_pred")
    return macro_f1(_truth(spark, sf_dir), sol)


MINMAX_COLS = ["position_ratio", "cosine_similarity", "euclidean_distance", "deep_style_cosine"]


@query("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    from styloscope.operators.model import ZeroMinMax
    p = _core_pairs(spark, sf_dir, ("clause_complexity",), tuple(MINMAX_COLS))
    return ZeroMinMax(inputCols=MINMAX_COLS).fit(p).transform(p)


def _stitched_pairs(spark, sf_dir):
    from styloscope.operators.evaluate import explode_changes
    from styloscope.operators.vectors import hashed_embeddings
    from styloscope.plans.features import pair_feature_table
    s = tb.stitched_sentences(spark, sf_dir)
    labels = explode_changes(_truth(spark, sf_dir)).select("problem_id", "pair_idx", "label")
    table = pair_feature_table(spark, s, hashed_embeddings(s), labels)
    diff = s.select("problem_id", "difficulty").distinct()
    return table.join(diff, "problem_id")


def _scored(spark, sf_dir):
    """Predictions of the stored pair table by stored models: fitted on the training problems, saved and read back."""
    from styloscope.operators import pairs as pr
    from styloscope.operators.model import fit_models, in_training, load_models, model_input, save_models, score
    from styloscope.session import scratch_path
    table = _stitched_pairs(spark, sf_dir)
    cols = [c for c in pr.numeric_feature_columns(table) if c not in ("difficulty",)]
    data = store(model_input(table, cols).withColumn("in_training", in_training()), "model-input")
    models = scratch_path(spark, "models")
    save_models(fit_models(data.filter("in_training"), cols), models)
    return score(data, load_models(spark, models)).withColumn("in_training", in_training())


@query("score_changes")
def q_score_changes(spark, sf_dir):
    return _scored(spark, sf_dir)


@query("collect_changes")
def q_collect_changes(spark, sf_dir):
    from styloscope.operators.evaluate import collect_changes
    return collect_changes(_scored(spark, sf_dir), "y_pred", extra=["difficulty"])


@query("scoring_split")
def q_scoring_split(spark, sf_dir):
    """The problems that scoring trains on and holds out, with their pairs."""
    from styloscope.operators.model import in_training
    s = tb.stitched_sentences(spark, sf_dir).filter("n_sentences >= 2")
    return (s.select("problem_id", "difficulty", (F.col("n_sentences") - 1).alias("n_pairs")).distinct()
            .withColumn("in_training", in_training()))


@query("style_change_features")
def q_style_change_features(spark, sf_dir):
    """The full fixed-schema pair table of the documents (embeddings hashed from tokens)."""
    from styloscope.operators.vectors import hashed_embeddings
    from styloscope.plans.features import pair_feature_table
    s = _sentences(spark, sf_dir)
    return pair_feature_table(spark, s, hashed_embeddings(s))


# --- W9 / J4 (sliding-window graph drift) -----------------------------------------------------

@query("wan_window_graphs")
def q_wan_window_graphs(spark, sf_dir):
    from styloscope.operators.drift import window_features
    return window_features(_sentences(spark, sf_dir), with_paths=False)


@query("wan_window_drift")
def q_wan_window_drift(spark, sf_dir):
    from styloscope.operators.drift import wan_window_drift
    return wan_window_drift(spark, _sentences(spark, sf_dir), with_paths=False)


# --- S1-S8 (file scans and sinks, round-tripped through the shared checkpoint folder) --------

@query("roundtrip_problem_files")
def q_roundtrip_problem_files(spark, sf_dir):
    from styloscope.session import scratch_path
    from styloscope.sources.files import read_problems, write_problems
    out = scratch_path(spark, "problems")
    write_problems(tb.problems(spark, sf_dir), out)
    back = read_problems(spark, out)
    return back.select("problem_id", "difficulty", F.size(F.split("text", "\n")).cast("int").alias("n_sentences"))


@query("truth_scan")
def q_truth_scan(spark, sf_dir):
    """Truth arrays written as records and scanned back."""
    from styloscope.session import scratch_path
    from styloscope.sources.files import read_solutions, write_solutions
    out = scratch_path(spark, "truth")
    write_solutions(_truth(spark, sf_dir), out)
    return read_solutions(spark, out).select(F.col("problem_id").cast("long").alias("problem_id"), "difficulty", F.size("changes").alias("n_pairs"),
                                             F.aggregate("changes", F.lit(0), lambda a, x: a + x).alias("n_changes"))


@query("graph_sink")
def q_graph_sink(spark, sf_dir):
    from styloscope.session import scratch_path
    from styloscope.operators.adjacency import KEY, edge_table
    from styloscope.sources.files import write_graphs
    edges = edge_table(_wan(spark, sf_dir), KEY)
    out = scratch_path(spark, "graphs")
    write_graphs(edges.join(tb.problems(spark, sf_dir).select("problem_id", "difficulty"), "problem_id"), out)
    back = spark.read.parquet(out)
    return back.groupBy("difficulty", "edge_type").agg(F.count(F.lit(1)).alias("n_edges"),
                                                       F.sum("weight").alias("total_weight"))


@query("metric_sink")
def q_metric_sink(spark, sf_dir):
    from styloscope.operators.evaluate import collect_changes, macro_f1, relative_length_predictor
    from styloscope.session import scratch_path
    from styloscope.sources.files import read_metrics, read_solutions, write_metrics, write_solutions
    st = tb.stitched_sentences(spark, sf_dir)
    sol = collect_changes(relative_length_predictor(st), "y_pred").join(
        st.select("problem_id", "difficulty").distinct(), "problem_id")
    sol_dir = scratch_path(spark, "solutions")
    write_solutions(sol, sol_dir)
    read = read_solutions(spark, sol_dir).select(F.col("problem_id").cast("long").alias("problem_id"), "changes")
    scores = macro_f1(_truth(spark, sf_dir), read)
    task = F.create_map(F.lit("easy"), F.lit("task1_f1_score"), F.lit("medium"), F.lit("task2_f1_score"),
                        F.lit("hard"), F.lit("task3_f1_score"))
    metrics = scores.select(task[F.col("difficulty")].alias("key"), F.col("macro_f1").alias("value"))
    out = scratch_path(spark, "metrics")
    write_metrics(metrics, out)
    return read_metrics(spark, out).select("key", F.col("value").cast("double").alias("value"))


# --- Incremental (Structured Streaming) run of the flagship ----------------------------------

@query("stream_rhythm_pairs")
def q_stream_rhythm_pairs(spark, sf_dir):
    from styloscope.streaming.problems import document_stream, run_incremental
    out = run_incremental(spark, document_stream(spark, sf_dir),
                          lambda problems: rh.rhythm_pairs(se.split_sentences(problems)), name="rhythm")
    return spark.read.parquet(out).drop("epoch")
