"""The fixed-schema pair feature table.

Sentence-level families are joined on (problem_id, sent_idx) (each family is grouped by that key,
so the joins are co-partitioned), neighbour values come from the composite-key neighbour operator,
and the hundreds of pair columns are one generated ``select`` (never a ``withColumn`` loop).
Missing / NaN / infinite values become 0 at the end (P7); the label stays nullable (D6).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.functions import lexicons as lx
from styloscope.functions.numeric import nan_inf_to_zero, repaired
from styloscope.operators.sequence import framed, with_neighbours

KEY = ["problem_id", "sent_idx"]
PAIR_KEY = ["problem_id", "pair_idx"]

GRAPH_COUNT_FEATURES = [
    "average_degree", "density", "average_clustering", "assortativity", "degree_entropy",
    "degree_centrality_mean", "degree_centrality_std", "degree_centrality_max", "degree_centrality_min",
    "in_degree_mean", "in_degree_std", "out_degree_mean", "out_degree_std",
    "pos_node_count", "pos_avg_degree", "pos_density", "pos_centrality_mean", "pos_centrality_std",
]
GRAPH_PATH_FEATURES = [f"{m}_centrality_{s}" for m in ("closeness", "betweenness", "eigenvector")
                       for s in ("mean", "std", "max", "min")]
LEXICAL_FEATURES = [
    "ttr", "yules_k", "avg_word_len", "sentence_char_len", "sentence_token_len", "char_alpha_ratio",
    "char_per_token", "repeated_punct", "markdown_emphasis", "all_caps_words", "function_word_ratio",
    "pronoun_ratio", "conjunction_ratio", "preposition_ratio", "first_person_ratio", "second_person_ratio",
    "third_person_ratio", "stopword_ratio", "char_upper_ratio", "flesch_reading_ease", "gunning_fog",
    "automated_readability_index", "syllable_count", "dale_chall_score",
]
DEEP_FEATURES = [
    "formality_score", "ner_density", "modal_word_ratio", "discourse_marker_ratio", "has_emoji", "has_non_ascii",
    "has_quoted_text", "sentiment_polarity", "subjectivity_score", "rhetorical_question", "has_all_caps",
    "sarcasm_marker", *lx.LIWC_CATEGORIES.keys(),
]
PATTERN_FEATURES = [
    "pattern_type", "flag_pattern_1", "flag_pattern_2", "flag_pattern_3", "flag_pattern_4", "flag_special_meta",
    "pattern_same_block", "pattern_boundary_cross", "pattern_block_start", "pattern_block_end",
]
SYNTAX_FEATURES = ["dependency_avg_depth", "passive_ratio", "clause_complexity"]
CONTEXT_FEATURES = ["avg_sbert_cosine_neighbors", "ner_overlap_next", "lemma_overlap_next", "starts_with_discourse",
                    "subject_overlap_prev"]

# Feature set the SQL oracle can reproduce end to end.
CORE_FEATURES = GRAPH_COUNT_FEATURES + LEXICAL_FEATURES + DEEP_FEATURES + PATTERN_FEATURES
FULL_FEATURES = (GRAPH_COUNT_FEATURES + GRAPH_PATH_FEATURES + LEXICAL_FEATURES + SYNTAX_FEATURES + DEEP_FEATURES
                 + PATTERN_FEATURES + CONTEXT_FEATURES)


def _vec_sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def assemble_pairs(sent: DataFrame, cols: list[str], positions: DataFrame,
                   extras: list[DataFrame] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The pair table: one row per (problem_id, pair_idx) of problems with >= 2 sentences.

    ``sent`` has KEY + ``cols`` (numeric, null = undefined); ``positions`` is pair_positions();
    ``extras`` are pair-level families keyed PAIR_KEY; ``labels`` is (problem_id, pair_idx, label).
    """
    typed = sent.select(*KEY, *[F.col(c).cast("double").alias(c) for c in cols])
    nb = with_neighbours(typed, ["problem_id"], "sent_idx", cols, [1])
    a = {c: F.col(c) for c in cols}
    b = {c: F.col(f"{c}_next") for c in cols}
    za = [nan_inf_to_zero(a[c]) for c in cols]
    zb = [nan_inf_to_zero(b[c]) for c in cols]
    dot = _vec_sum([x * y for x, y in zip(za, zb)])
    na = F.sqrt(_vec_sum([x * x for x in za]))
    nb_ = F.sqrt(_vec_sum([y * y for y in zb]))
    cos = F.when((na * nb_) == 0, F.lit(0.0)).otherwise(dot / (na * nb_))
    euc = F.sqrt(_vec_sum([(x - y) * (x - y) for x, y in zip(za, zb)]))
    select = [F.col("problem_id"), F.col("sent_idx").alias("pair_idx"),
              cos.alias("cosine_similarity"), euc.alias("euclidean_distance")]
    select += [a[c].alias(f"f1_{c}") for c in cols] + [b[c].alias(f"f2_{c}") for c in cols]
    select += [(b[c] - a[c]).alias(f"delta_{c}") for c in cols]
    select += [F.abs(a[c] - b[c]).alias(f"diff_{c}") for c in cols]
    select += [(b[k] > a[k]).cast("int").alias(f"{k}_increased") for k in lx.INCREASED_KEYS if k in cols]
    if all(k in cols for k in lx.DEEP_STYLE_KEYS):
        x = [nan_inf_to_zero(a[k]) for k in lx.DEEP_STYLE_KEYS]
        y = [nan_inf_to_zero(b[k]) for k in lx.DEEP_STYLE_KEYS]
        d = _vec_sum([p * q for p, q in zip(x, y)])
        den = F.sqrt(_vec_sum([p * p for p in x])) * F.sqrt(_vec_sum([q * q for q in y]))
        select.append(F.when(den == 0, F.lit(0.0)).otherwise(d / den).alias("deep_style_cosine"))
    pairs = nb.select(*select)
    # inner join with the pair positions keeps exactly the pairs (i, i+1) of problems with n >= 2
    out = positions.select(*PAIR_KEY, "position_ratio").join(pairs, PAIR_KEY, "inner")
    for e in extras or []:
        out = out.join(e, PAIR_KEY, "left")
    if labels is not None:
        out = out.join(labels.select(*PAIR_KEY, "label"), PAIR_KEY, "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("int"))
    return out


def fill_numeric(df: DataFrame, keep: tuple[str, ...] = ("problem_id", "pair_idx", "label", "difficulty")) -> DataFrame:
    """NaN / +-inf / null -> 0 for every numeric column except keys and the label, and in arrays of floats."""
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, NumericType
    return df.select(*[repaired(f.name).alias(f.name) if f.name not in keep and isinstance(f.dataType, ArrayType)
                       and isinstance(f.dataType.elementType, (DoubleType, FloatType)) else
                       F.col(f.name) if f.name in keep or not isinstance(f.dataType, NumericType)
                       else (nan_inf_to_zero(f.name) if f.dataType.typeName() in ("double", "float")
                             else F.coalesce(F.col(f.name), F.lit(0))).alias(f.name)
                       for f in df.schema.fields])


def smooth(pairs: DataFrame, keys: list[str], window: int = lx.WINDOW_SIZE) -> DataFrame:
    """Centred mean over pair_idx-h .. pair_idx+h truncated at the ends; absent values count as 0.

    Returns (problem_id, pair_idx, <key>_smooth...). An even window is an error.
    """
    if window % 2 != 1:
        raise ValueError("Window size must be odd")
    h = window // 2
    src = pairs.select(*PAIR_KEY, *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(k) for k in keys])
    return framed(src, ["problem_id"], "pair_idx", -h, h, [F.avg(k).alias(f"{k}_smooth") for k in keys])


def numeric_feature_columns(df: DataFrame, drop=("problem_id", "pair_idx", "sentence_index", "label")) -> list[str]:
    """Numeric columns minus ids and label."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in drop]


def label_last(df: DataFrame) -> DataFrame:
    """Label as the last column."""
    cols = [c for c in df.columns if c != "label"] + (["label"] if "label" in df.columns else [])
    return df.select(*cols)
