"""Sentence-level lexical, character, marker, readability and sentiment features.

All of it is read from the sentence's annotated row (``operators.annotated``) by Column expressions and higher-order
functions, without a shuffle. Only a caller's token table or lexicon tables take the other way: one
``groupBy(problem_id, sent_idx)`` over the tokens with conditional counts, partially aggregated map-side.

Sentences with no tokens (blank lines) keep their row through a left join and get the defaults of
the definitions (0, or 50 for formality).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.functions import annotate as an
from styloscope.functions.arrays import let, total
from styloscope.functions import lexicons as lx
from styloscope.functions.numeric import safe_div
from styloscope.functions import text as tx
from styloscope.operators.annotated import COLUMNS, annotate, count_of
from styloscope.operators.tokens import tokens as make_tokens

KEY = ["problem_id", "sent_idx"]


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def with_word_moments(df: DataFrame, words: Column, prefix: str = "_") -> DataFrame:
    """Add ``{prefix}types``, ``{prefix}m1``, ``{prefix}n_alpha`` for an array of words, in-row.

    Distinct count and sum of squared frequencies (Yule's M1) from the sorted array: run starts are the
    positions where the word changes, run lengths are differences of consecutive starts. Integer
    arithmetic only (no per-element struct allocation), O(n log n) per row, no grouping shuffle.
    """
    s = f"{prefix}sorted"
    st = f"{prefix}starts"
    out = df.withColumn(s, F.array_sort(words))
    n = F.size(F.col(s))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn(st, F.filter(idx, lambda i: (i == 0) | (F.get(F.col(s), i) != F.get(F.col(s), i - 1))))
    k = F.size(F.col(st))
    runs = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    length = lambda j: F.coalesce(F.get(F.col(st), j + 1), n) - F.get(F.col(st), j)
    m1 = F.aggregate(F.transform(runs, lambda j: (length(j) * length(j)).cast("long")), F.lit(0).cast("long"),
                     lambda acc, x: acc + x)
    return (out.withColumn(f"{prefix}types", k).withColumn(f"{prefix}m1", m1).withColumn(f"{prefix}n_alpha", n)
            .drop(s, st))


def syllables(word: Column) -> Column:
    """Vowel groups of a lowercase word, minus a silent final 'e'; at least 1 for words with a letter."""
    groups = F.regexp_count(word, F.lit(f"[{lx.SYLLABLE_VOWELS}]+"))
    silent = (word.rlike("[^l]e$") & (groups > 1)).cast("int")
    return F.when(word.rlike(r"\p{L}"), F.greatest(F.lit(1), groups - silent)).otherwise(F.lit(0))


def string_features(sentences: DataFrame) -> DataFrame:
    """In-row features of each sentence (no shuffle).

    The shared arrays (tokens, whitespace words) are materialised as columns first: higher-order
    functions re-evaluate an inline argument expression once per use.
    """
    rows = annotate(sentences)
    base = rows.select(*KEY, "sentence", *COLUMNS, tx.strip_ws("sentence").alias("_s")).select(
        *KEY, "_s", "sentence", *COLUMNS, tx.ws_words("_s").alias("_words"), tx.ws_words(F.lower("_s")).alias("_lwords"))
    s, toks = F.col("_s"), F.col("tok_text")
    alpha_lower = F.filter("tok_lower", lambda t: an.is_alpha(t))
    first = F.lower(F.get(toks, 0))
    first_word = F.lower(F.get(F.col("_words"), 0))
    rhetorical = (F.endswith(s, F.lit("?")) & F.coalesce(first_word.isin(lx.RHETORICAL_FIRST_WORDS), F.lit(False)))
    out = base.select(
        *KEY,
        F.length(s).alias("sentence_char_len"),
        F.regexp_count(s, F.lit(r"\p{L}")).alias("_alpha"),
        F.regexp_count(s, F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count(s, F.lit(r"\p{Nd}")).alias("_digit"),
        F.regexp_count(s, F.lit(r"[.!?]+")).alias("_rd_sents"),
        tx.repeated_punct(s).alias("repeated_punct"),
        tx.markdown_emphasis(s).alias("markdown_emphasis"),
        tx.has_emoji("sentence").alias("has_emoji"),
        tx.has_non_ascii("sentence").alias("has_non_ascii"),
        tx.has_quoted_text("sentence").alias("has_quoted_text"),
        rhetorical.cast("int").alias("rhetorical_question"),
        (tx.all_caps_count_of_words("_words") > 0).cast("int").alias("has_all_caps"),
        tx.sarcasm_marker("sentence").alias("sarcasm_marker"),
        tx.discourse_count("sentence").alias("_discourse"),
        *tx.liwc_counts_of_words("_lwords"),
        F.coalesce(first.isin(lx.DISCOURSE_MARKERS), F.lit(False)).cast("int").alias("starts_with_discourse"),
        F.size("tok_ents").alias("_entities"), *token_counts(), alpha_lower.alias("_alpha_words"))
    return with_word_moments(out, F.col("_alpha_words")).drop("_alpha_words")


def token_counts() -> list[Column]:
    """The counts of ``token_aggregates`` from the arrays of an annotated row, with the built-in list and rule."""
    low, tag = F.col("tok_lower"), F.col("tok_tag")
    words = F.filter("tok_text", lambda t: an.is_word(t))
    listed = lambda values, names: count_of(values, lambda t: t.isin(names))
    person = lambda names: count_of(low, lambda t: t.isin(names) & an.is_alpha(t))
    feeling = F.filter(low, lambda t: t.isin([w for w, *_ in lx.SENTIMENT_LEXICON]))
    mean = lambda found, k: let(found, lambda f: F.when(F.size(f) > 0, total(
        F.transform(f, lambda t: F.try_element_at(_sentiment_map(k), t)), "double") / F.size(f)))

    def of_words(w: Column) -> Column:
        measured = F.transform(w, lambda t: let(F.lower(t), lambda x: F.struct(
            syllables(x).alias("syl"), x.isin(lx.stopwords()).alias("stop"), F.length(t).alias("len"))))
        return let(measured, lambda m: F.struct(
            F.size(m).alias("_words"), total(F.transform(m, lambda x: x["syl"])).alias("syllable_count"),
            count_of(m, lambda x: x["syl"] >= 3).alias("_complex"),
            count_of(m, lambda x: (x["syl"] >= 3) & ~x["stop"]).alias("_difficult"),
            total(F.transform(m, lambda x: x["len"])).alias("_word_chars")))

    return [F.size(low).alias("_ntok"), total(F.transform("tok_text", lambda t: F.length(t))).alias("_sum_len"),
            count_of(F.col("tok_text"), lambda t: an.is_upper(t) & (F.length(t) > 1)).alias("all_caps_words"),
            listed(tag, lx.FUNCTION_POS_TAGS).alias("_fw"), listed(tag, ["PRON"]).alias("_pron"),
            listed(tag, ["CCONJ"]).alias("_cconj"), listed(tag, ["ADP"]).alias("_adp"),
            person(lx.FIRST_PERSON).alias("_p1"), person(lx.SECOND_PERSON).alias("_p2"),
            person(lx.THIRD_PERSON).alias("_p3"), person(lx.WH_WORDS).alias("_wh"),
            count_of(F.col("tok_stop"), lambda x: x).alias("_stop"),
            (listed(tag, lx.FORMALITY_PLUS) - listed(tag, lx.FORMALITY_MINUS)).alias("_formal"),
            count_of(F.col("tok_lemma"), lambda t: F.lower(t).isin(lx.MODAL_WORDS)).alias("_modal"),
            let(words, of_words).alias("_w"), mean(feeling, 0).alias("_pol"), mean(feeling, 1).alias("_subj")]


def token_aggregates(tokens: DataFrame, sentiment: DataFrame | None = None,
                     easy_words: DataFrame | None = None) -> DataFrame:
    """One grouped pass over the tokens table: every count the ratios need.

    ``sentiment`` (word, polarity, subjectivity) and ``easy_words`` (word) are lexicon tables in place of the built-in
    list and rule: they are joined on the lower-cased token, words once each.
    """
    up, low = F.col("upos"), F.col("lower")
    word = an.is_word(F.col("text"))
    syl = syllables(low)
    polarity, subjectivity = F.try_element_at(_sentiment_map(0), low), F.try_element_at(_sentiment_map(1), low)
    difficult = word & (syl >= 3) & ~F.col("is_stop")
    if sentiment is not None:
        table = sentiment.groupBy(F.col("word").alias("lower")).agg(
            F.first("polarity").cast("double").alias("_polarity"),
            F.first("subjectivity").cast("double").alias("_subjectivity"))
        tokens = tokens.join(table, "lower", "left")
        polarity, subjectivity = F.col("_polarity"), F.col("_subjectivity")
    if easy_words is not None:
        tokens = tokens.join(easy_words.select(F.col("word").alias("lower")).distinct().withColumn("_easy", F.lit(True)),
                             "lower", "left")
        difficult = word & F.col("_easy").isNull()
    return tokens.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_ntok"),
        F.sum(F.length("text")).alias("_sum_len"),
        _count_if(F.col("is_upper") & (F.length("text") > 1)).alias("all_caps_words"),
        _count_if(up.isin(lx.FUNCTION_POS_TAGS)).alias("_fw"),
        _count_if(up == "PRON").alias("_pron"),
        _count_if(up == "CCONJ").alias("_cconj"),
        _count_if(up == "ADP").alias("_adp"),
        _count_if(F.col("is_alpha") & low.isin(lx.FIRST_PERSON)).alias("_p1"),
        _count_if(F.col("is_alpha") & low.isin(lx.SECOND_PERSON)).alias("_p2"),
        _count_if(F.col("is_alpha") & low.isin(lx.THIRD_PERSON)).alias("_p3"),
        _count_if(F.col("is_alpha") & low.isin(lx.WH_WORDS)).alias("_wh"),
        _count_if(F.col("is_stop")).alias("_stop"),
        (_count_if(up.isin(lx.FORMALITY_PLUS)) - _count_if(up.isin(lx.FORMALITY_MINUS))).alias("_formal"),
        _count_if(F.lower("lemma").isin(lx.MODAL_WORDS)).alias("_modal"),
        _count_if(word).alias("_words"),
        F.sum(F.when(word, syl).otherwise(0)).alias("syllable_count"),
        _count_if(word & (syl >= 3)).alias("_complex"),
        _count_if(difficult).alias("_difficult"),
        F.sum(F.when(word, F.length("text")).otherwise(0)).alias("_word_chars"),
        F.avg(polarity).alias("_pol"),
        F.avg(subjectivity).alias("_subj"),
    )


def _sentiment_map(i: int) -> Column:
    return F.create_map(*[x for w, *vals in lx.SENTIMENT_LEXICON for x in (F.lit(w), F.lit(float(vals[i])))])


def readability(words, sents, syl, complex_, difficult, chars) -> list[Column]:
    """Published Flesch, Gunning fog, ARI and Dale-Chall formulas; all 0 when there are no words."""
    wps = safe_div(words, sents)
    spw = safe_div(syl, words)
    pct_difficult = 100.0 * safe_div(difficult, words)
    has = words > 0
    return [
        F.when(has, 206.835 - 1.015 * wps - 84.6 * spw).otherwise(0.0).alias("flesch_reading_ease"),
        F.when(has, 0.4 * (wps + 100.0 * safe_div(complex_, words))).otherwise(0.0).alias("gunning_fog"),
        F.when(has, 4.71 * safe_div(chars, words) + 0.5 * wps - 21.43).otherwise(0.0).alias("automated_readability_index"),
        F.when(has, 0.1579 * pct_difficult + 0.0496 * wps + F.when(pct_difficult > 5, 3.6365).otherwise(0.0))
        .otherwise(0.0).alias("dale_chall_score"),
    ]


LEXICAL_COLUMNS = [
    "ttr", "yules_k", "avg_word_len", "sentence_char_len", "sentence_token_len", "char_alpha_ratio",
    "char_per_token", "char_upper_ratio", "char_digit_ratio", "repeated_punct", "markdown_emphasis", "all_caps_words",
    "function_word_ratio", "pronoun_ratio", "conjunction_ratio", "preposition_ratio", "first_person_ratio",
    "second_person_ratio", "third_person_ratio", "stopword_ratio", "flesch_reading_ease", "gunning_fog",
    "automated_readability_index", "syllable_count", "dale_chall_score",
]
DEEP_COLUMNS = [
    "formality_score", "ner_density", "modal_word_ratio", "discourse_marker_ratio", "has_emoji", "has_non_ascii",
    "has_quoted_text", "sentiment_polarity", "subjectivity_score", "rhetorical_question", "has_all_caps",
    "sarcasm_marker", *lx.LIWC_CATEGORIES.keys(),
]


def lexical_features(sentences: DataFrame, tokens: DataFrame | None = None, sentiment: DataFrame | None = None,
                     easy_words: DataFrame | None = None) -> DataFrame:
    """(problem_id, sent_idx, LEXICAL_COLUMNS..., DEEP_COLUMNS..., wh_word_ratio, starts_with_discourse).

    A caller's annotations (``tokens``) and lexicon tables (see ``token_aggregates``) replace the built-in ones.
    """
    j = string_features(sentences)
    if tokens is None and sentiment is None and easy_words is None:
        j = j.select("*", "_w.*")
    else:
        counted = ["_ntok", "_sum_len", "all_caps_words", "_fw", "_pron", "_cconj", "_adp", "_p1", "_p2", "_p3", "_wh",
                   "_stop", "_formal", "_modal", "_w", "_pol", "_subj"]
        ta = token_aggregates(tokens if tokens is not None else make_tokens(sentences), sentiment, easy_words)
        j = j.drop(*counted).join(ta, KEY, "left")
    n = F.coalesce(F.col("_ntok"), F.lit(0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    chars = F.col("sentence_char_len")
    return j.select(
        *KEY,
        safe_div(F.col("_types"), n).alias("ttr"),
        F.when(F.col("_n_alpha") > 0,
               1e4 * (F.col("_m1") - F.col("_n_alpha")) / (F.col("_n_alpha").cast("double") ** 2))
        .otherwise(F.lit(0.0)).alias("yules_k"),
        safe_div(z("_sum_len"), n).alias("avg_word_len"),
        chars.alias("sentence_char_len"),
        n.cast("long").alias("sentence_token_len"),
        safe_div(F.col("_alpha"), chars).alias("char_alpha_ratio"),
        safe_div(chars, n).alias("char_per_token"),
        safe_div(F.col("_upper"), chars).alias("char_upper_ratio"),
        safe_div(F.col("_digit"), chars).alias("char_digit_ratio"),
        "repeated_punct", "markdown_emphasis",
        z("all_caps_words").cast("long").alias("all_caps_words"),
        safe_div(z("_fw"), n).alias("function_word_ratio"),
        safe_div(z("_pron"), n).alias("pronoun_ratio"),
        safe_div(z("_cconj"), n).alias("conjunction_ratio"),
        safe_div(z("_adp"), n).alias("preposition_ratio"),
        safe_div(z("_p1"), n).alias("first_person_ratio"),
        safe_div(z("_p2"), n).alias("second_person_ratio"),
        safe_div(z("_p3"), n).alias("third_person_ratio"),
        safe_div(z("_stop"), n).alias("stopword_ratio"),
        safe_div(z("_wh"), n).alias("wh_word_ratio"),
        *readability(z("_words"), F.greatest(F.lit(1), F.col("_rd_sents")),
                     z("syllable_count"), z("_complex"), z("_difficult"), z("_word_chars")),
        z("syllable_count").cast("long").alias("syllable_count"),
        F.when(n > 0, 50.0 + 0.5 * safe_div(z("_formal"), n)).otherwise(F.lit(50.0)).alias("formality_score"),
        safe_div(F.col("_entities"), n).alias("ner_density"),
        safe_div(z("_modal"), n).alias("modal_word_ratio"),
        safe_div(F.col("_discourse"), n).alias("discourse_marker_ratio"),
        "has_emoji", "has_non_ascii", "has_quoted_text",
        F.coalesce(F.col("_pol"), F.lit(0.0)).alias("sentiment_polarity"),
        F.coalesce(F.col("_subj"), F.lit(0.0)).alias("subjectivity_score"),
        "rhetorical_question", "has_all_caps", "sarcasm_marker", *lx.LIWC_CATEGORIES.keys(),
        "starts_with_discourse",
    )
