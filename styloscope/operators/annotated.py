"""One annotated row per sentence, which every token-based family reads in its row.

``annotate`` adds parallel arrays to a sentences table: tok_text, tok_lower, tok_tag, tok_lemma, tok_stop, and the entity
spans tok_ents. Operators that find these columns take them instead of tokenising and tagging the sentence again; stored
once, the row serves lexical counts, n-grams, overlaps, dependencies and graphs without an explode. Arrays that a query
does not read are pruned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.functions import annotate as an
from styloscope.functions import lexicons as lx
from styloscope.functions.arrays import let, run_heads, run_lengths, total
from styloscope.functions.text import casefold, tokenize

COLUMNS = ("tok_text", "tok_lower", "tok_tag", "tok_lemma", "tok_stop", "tok_ents")


def is_annotated(df: DataFrame) -> bool:
    return "tok_tag" in df.columns


def annotate(sentences: DataFrame) -> DataFrame:
    """``sentences`` with the token arrays of the built-in annotator."""
    if is_annotated(sentences):
        return sentences
    keep = sentences.columns
    text = sentences.select(*keep, tokenize("sentence").alias("tok_text"))
    lower = text.select(*keep, "tok_text", F.transform("tok_text", lambda t: F.lower(t)).alias("tok_lower"))
    return lower.select(*keep, "tok_text", "tok_lower",
                        F.transform("tok_lower", lambda t: an.upos_lower(t)).alias("tok_tag"),
                        F.transform("tok_lower", lambda t: an.lemma_lower(t)).alias("tok_lemma"),
                        F.transform("tok_lower", lambda t: t.isin(lx.stopwords())).alias("tok_stop"),
                        an.entity_spans(F.col("tok_text")).alias("tok_ents"))


def count_of(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test))


def folds(sentence: Column) -> Column:
    """Whether case folding differs from lower case (a sharp s becomes two letters)."""
    return F.contains(F.lower(sentence), F.lit("ß"))


def folded_words() -> tuple[Column, Column]:
    """Casefolded tokens of an annotated sentence and their tags."""
    again = tokenize(casefold(F.col("sentence")))
    return (F.when(folds(F.col("sentence")), again).otherwise(F.col("tok_lower")),
            F.when(folds(F.col("sentence")), F.transform(again, lambda t: an.upos_lower(t))).otherwise(F.col("tok_tag")))


def normalized() -> Column:
    """P4 from the arrays: structs (word, tag) of the words left under the row's preset flags, with the tags of these words."""
    def of(rows: Column) -> Column:
        kept = F.filter(rows, lambda x: ~((F.col("remove_stopwords") & x["stop"])
                                          | (F.col("remove_punct") & an.is_punct(x["low"]))))
        return F.transform(kept, lambda x: F.when(F.col("lemmatize"), F.struct(
            x["lemma"].alias("word"), an.upos_lower(x["lemma"]).alias("tag"))).otherwise(
            F.struct(x["low"].alias("word"), x["tag"].alias("tag"))))

    stored = F.arrays_zip(F.col("tok_lower").alias("low"), F.col("tok_lemma").alias("lemma"),
                          F.col("tok_stop").alias("stop"), F.col("tok_tag").alias("tag"))
    again = F.transform(tokenize(casefold(F.col("sentence"))), lambda t: F.struct(
        t.alias("low"), an.lemma_lower(t).alias("lemma"), t.isin(lx.stopwords()).alias("stop"), an.upos_lower(t).alias("tag")))
    return of(F.when(folds(F.col("sentence")), again).otherwise(stored))


def gram_counts(grams: Column) -> Column:
    """struct(grams, n): sorted distinct elements and how often each occurs."""
    return let(F.sort_array(grams), lambda s: F.struct(
        F.transform(run_heads(s), lambda at: F.get(s, at)).alias("grams"), run_lengths(s).alias("n")))


def entropy(counts: Column) -> Column:
    """Natural-log entropy of an array of counts; 0 for none."""
    weighted = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * F.log(x))
    return let(counts, lambda c: F.when(F.size(c) > 0, F.log(total(c)) - weighted(c) / total(c)).otherwise(0.0))
