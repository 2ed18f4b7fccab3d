"""The annotated sentence row against the token table and against tokenising again."""

import pytest
from pyspark.sql import functions as F

from conftest import sentences_df
from styloscope.operators import annotated as ao
from styloscope.operators.lexical import lexical_features
from styloscope.operators.tokens import normalize_sentences, normalized_tokens, tokens

TEXTS = ["The cats were running quickly, weren't they?\n\nStraße STRASSE grüßt xleß İstanbul ΟΔΟΣ!",
         "I love Great Britain and New York; you hate 3 cats.\nI'm sure -- THIS is TERRIBLE!! @x\nhe can't",
         "one", "  \n.", "wonderfully beautiful syllables are interesting " * 50]


def test_lexical_counts_equal_the_token_table(spark):
    s = sentences_df(spark, TEXTS)
    want = {(r.problem_id, r.sent_idx): r.asDict() for r in lexical_features(s, tokens(s)).collect()}
    got = {(r.problem_id, r.sent_idx): r.asDict() for r in lexical_features(ao.annotate(s)).collect()}
    assert set(got) == set(want) and len(got) == 10
    for k, row in want.items():
        for name, value in row.items():
            assert got[k][name] == (value if value is None else pytest.approx(value, abs=1e-12)), (k, name)


@pytest.mark.parametrize("preset", ["C1", "C3", "C9", "C14", "C16"])
def test_normalised_words_equal_those_of_the_folded_sentence(spark, preset):
    s = sentences_df(spark, TEXTS)
    got = normalize_sentences(spark, ao.annotate(s), preset).select("problem_id", "sent_idx", "norm_tokens", "norm_tags")
    plain = normalize_sentences(spark, s, preset).select("problem_id", "sent_idx", F.col("norm_tokens").alias("want"))
    rows = got.join(plain, ["problem_id", "sent_idx"]).collect()
    assert len(rows) == 10 and all(r.norm_tokens == r.want and len(r.norm_tags) == len(r.want) for r in rows)


def test_folded_words(spark):
    word, tag = ao.folded_words()
    no = F.lit(False)
    rows = ao.annotate(sentences_df(spark, TEXTS)).select(
        word.alias("w"), tag.alias("t"), normalized_tokens(F.col("sentence"), no, no, no).alias("want")).collect()
    assert all(r.w == r.want and len(r.t) == len(r.w) for r in rows)


def test_a_stored_row_is_not_tagged_again(spark):
    stored = ao.annotate(sentences_df(spark, TEXTS))
    assert ao.annotate(stored) is stored
    plan = lexical_features(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[\p{L}\p{M}\p{N}]+|") == 1 and "Join" not in plan and "Aggregate" not in plan
