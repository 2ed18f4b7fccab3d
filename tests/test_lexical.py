import math

from conftest import sentences_df
from styloscope.operators.lexical import lexical_features


def feats(spark, text):
    rows = lexical_features(sentences_df(spark, [text])).orderBy("sent_idx").collect()
    return [r.asDict() for r in rows]


def test_blank_line_defaults(spark):
    f = feats(spark, "word\n")[1]
    assert f["sentence_token_len"] == 0 and f["formality_score"] == 50.0 and f["ttr"] == 0.0
    assert f["yules_k"] == 0.0 and f["flesch_reading_ease"] == 0.0


def test_ttr_yules_and_ratios(spark):
    f = feats(spark, "The cat saw the cat, I think.")[0]
    toks = ["The", "cat", "saw", "the", "cat", ",", "I", "think", "."]
    assert f["sentence_token_len"] == len(toks)
    assert abs(f["ttr"] - 5 / 9) < 1e-12                      # the, cat, saw, i, think
    freqs = [2, 2, 1, 1, 1]
    n = sum(freqs)
    assert abs(f["yules_k"] - 1e4 * (sum(x * x for x in freqs) - n) / n ** 2) < 1e-9
    assert abs(f["first_person_ratio"] - 1 / 9) < 1e-12
    assert abs(f["avg_word_len"] - sum(map(len, toks)) / 9) < 1e-12
    assert f["sentence_char_len"] == len("The cat saw the cat, I think.")


def test_markers_and_liwc_semantics(spark):
    f = feats(spark, "An enthusiast, thus, happy!! \"quoted\" WOW")[0]
    # discourse markers are substring tests: "thus" also hits "enthusiast" but counts once
    assert abs(f["discourse_marker_ratio"] - 1 / f["sentence_token_len"]) < 1e-12
    assert f["liwc_analytic_count"] == 0          # "thus," keeps its comma on a whitespace split
    assert f["liwc_affective_count"] == 0         # "happy!!" likewise
    assert f["sarcasm_marker"] == 1 and f["has_quoted_text"] == 1 and f["repeated_punct"] == 1
    assert f["has_all_caps"] == 1 and f["has_non_ascii"] == 0


def test_rhetorical_and_emoji(spark):
    f = feats(spark, "Why would anyone do that?\nnice 😀 day\nIs it?")
    assert f[0]["rhetorical_question"] == 1 and f[1]["has_emoji"] == 1 and f[2]["rhetorical_question"] == 1
    assert f[1]["has_non_ascii"] == 1 and f[0]["has_emoji"] == 0


def test_readability_formulas(spark):
    f = feats(spark, "The cat sat on the mat.")[0]
    words, sents, syl = 6, 1, 6
    assert abs(f["flesch_reading_ease"] - (206.835 - 1.015 * words / sents - 84.6 * syl / words)) < 1e-9
    assert f["syllable_count"] == syl
    assert math.isclose(f["automated_readability_index"], 4.71 * (17 / 6) + 0.5 * 6 - 21.43, rel_tol=1e-12)
