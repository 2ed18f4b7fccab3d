"""Tokenise + annotate, and the preset-driven sentence normaliser.

Tokens of a sentence come from one row, so they are produced in-row (``regexp_extract_all`` +
``posexplode``) with no shuffle. The annotation is a set of Column expressions (see
``functions.annotate``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.functions import annotate as an
from styloscope.functions import lexicons as lx
from styloscope.functions.text import casefold, tokenize

KEY = ["problem_id", "sent_idx"]


def tokens(sentences: DataFrame) -> DataFrame:
    """The ``tokens`` contract table: (problem_id, sent_idx, tok_idx, text, lower, lemma, upos, tag,
    is_alpha, is_punct, is_stop, is_upper, is_entity)."""
    t = sentences.select(*KEY, F.posexplode(tokenize("sentence")).alias("tok_idx", "text"))
    tok = F.col("text")
    return t.select(
        *KEY, F.col("tok_idx").cast("int"), "text", F.lower(tok).alias("lower"), an.lemma(tok).alias("lemma"),
        an.upos(tok).alias("upos"), an.upos(tok).alias("tag"), an.is_alpha(tok).alias("is_alpha"),
        an.is_punct(tok).alias("is_punct"), an.is_stop(tok).alias("is_stop"), an.is_upper(tok).alias("is_upper"),
        an.is_entity_token(tok, F.col("tok_idx")).alias("is_entity"))


def token_arrays(annotations: DataFrame, *columns: str) -> DataFrame:
    """(problem_id, sent_idx, tokens): a sentence's annotated tokens in order, as structs of ``columns``."""
    pair = F.struct("tok_idx", F.struct(*columns).alias("token"))
    rows = annotations.groupBy(*KEY).agg(F.array_sort(F.collect_list(pair)).alias("_pairs"))
    return rows.select(*KEY, F.transform("_pairs", lambda p: p["token"]).alias("tokens"))


def preset_table(spark: SparkSession) -> DataFrame:
    """The 16 presets as a DataFrame (remove_punct, remove_stopwords, lemmatize, include_pos)."""
    rows = [(name, *flags) for name, flags in lx.PRESETS.items()]
    return spark.createDataFrame(
        rows, "preset string, remove_punct boolean, remove_stopwords boolean, lemmatize boolean, include_pos boolean")


def with_preset(spark: SparkSession, df: DataFrame, preset: str | None = None) -> DataFrame:
    """Attach the preset flags: a fixed preset name, or the per-difficulty choice.

    The preset table has 16 rows by definition, so broadcasting it is size-safe.
    """
    if preset is not None:
        if preset not in lx.PRESETS:
            raise ValueError(f"Invalid preset: {preset}")
        name = F.lit(preset)
    else:
        name = F.element_at(F.create_map(*[F.lit(x) for kv in lx.DIFFICULTY_PRESET.items() for x in kv]),
                            F.col("difficulty"))
    return df.withColumn("preset", name).join(F.broadcast(preset_table(spark)), "preset")


def normalized_tokens(sentence, remove_punct, remove_stopwords, lemmatize):
    """P4 as an array: casefold, drop stop/punct tokens per flags, lemma or text, in order."""
    toks = tokenize(casefold(sentence))  # already lowercase: the annotator's *_lower forms apply directly
    stop = lx.stopwords()
    kept = F.filter(toks, lambda t: ~((remove_stopwords & t.isin(stop)) | (remove_punct & an.is_punct(t))))
    return F.transform(kept, lambda t: F.when(lemmatize, an.lemma_lower(t)).otherwise(t))


def normalize_sentences(spark: SparkSession, sentences: DataFrame, preset: str | None = None,
                        annotations: DataFrame | None = None) -> DataFrame:
    """P5: (problem_id, sent_idx, preset, include_pos, norm_tokens) for every sentence, using the problem's preset.

    With a caller's ``annotations`` (the ``tokens`` table) its texts, lemmas, stop and punctuation flags are used,
    and norm_tags carries its upos for the graphs' tag nodes.
    """
    s = with_preset(spark, sentences, preset)
    if annotations is not None:
        s = s.join(token_arrays(annotations, "lower", "lemma", "upos", "is_stop", "is_punct"), KEY, "left")
        dropped = lambda t: (F.col("remove_stopwords") & t["is_stop"]) | (F.col("remove_punct") & t["is_punct"])
        kept = F.filter("tokens", lambda t: ~dropped(t))
        s = s.withColumn("kept", kept)
        empty = F.array().cast("array<string>")
        word = lambda t: F.when(F.col("lemmatize"), F.lower(t["lemma"])).otherwise(t["lower"])
        return s.select(*KEY, "preset", "include_pos",
                        F.coalesce(F.transform("kept", word), empty).alias("norm_tokens"),
                        F.coalesce(F.transform("kept", lambda t: t["upos"]), empty).alias("norm_tags"))
    if "tok_tag" in s.columns:  # an annotated sentence row
        from styloscope.operators.annotated import normalized
        s = s.select(*KEY, "preset", "include_pos", normalized().alias("norm"))
        return s.select(*KEY, "preset", "include_pos", F.col("norm.word").alias("norm_tokens"),
                        F.col("norm.tag").alias("norm_tags"))
    norm = normalized_tokens(F.col("sentence"), F.col("remove_punct"), F.col("remove_stopwords"), F.col("lemmatize"))
    return s.select(*KEY, "preset", "include_pos", norm.alias("norm_tokens"))
