"""A caller's annotations, entities and lexicon tables take the place of the built-in ones."""
import pytest
from conftest import sentences_df

from styloscope.functions import lexicons as lx
from styloscope.operators.context import entity_overlap, lemma_overlap
from styloscope.operators.graphs import wan_for_sentences
from styloscope.operators.lexical import lexical_features
from styloscope.operators.pos import ngram_counts, tfidf_cosine
from styloscope.operators.tokens import tokens

SCHEMA = ("problem_id long, sent_idx int, tok_idx int, text string, lower string, lemma string, upos string, "
          "tag string, is_alpha boolean, is_punct boolean, is_stop boolean, is_upper boolean, is_entity boolean")


@pytest.fixture()
def own(spark):
    words = [(0, ["dogs", "bark"], ["dog", "bark"], ["XX", "YY"]), (1, ["a", "dog"], ["a", "dog"], ["ZZ", "XX"])]
    rows = [(0, i, k, t, t, m, u, u, True, False, False, False, False)
            for i, texts, lemmas, tags in words for k, (t, m, u) in enumerate(zip(texts, lemmas, tags))]
    return spark.createDataFrame(rows, SCHEMA)


def test_supplied_tokens_change_graphs_ngrams_and_lemmas(spark, own):
    s = sentences_df(spark, ["dogs bark\na dog"])
    edges, nodes = wan_for_sentences(spark, s, "C8", own)
    assert {r.node for r in nodes.collect() if r.node_type == "POS"} == {"POS_XX", "POS_YY", "POS_ZZ"}
    assert ("dog", "bark") in {(r.src, r.dst) for r in edges.collect()}
    assert {r.ngram for r in ngram_counts(s, 2, tokens=own).collect()} == {"XX_YY", "ZZ_XX"}
    assert [r.lemma_overlap_next for r in lemma_overlap(s, own).orderBy("sent_idx").collect()] == [1 / 3, 0.0]
    assert tfidf_cosine(s, own).count() == 1


def test_built_in_annotations_as_a_table_change_nothing(spark):
    s = sentences_df(spark, ["The old dog sleeps.\nA big dog barked at Paris today."])
    table = tokens(s)
    for left, right in zip(wan_for_sentences(spark, s, "C2"), wan_for_sentences(spark, s, "C2", table)):
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))
    assert sorted(map(tuple, ngram_counts(s, 3).collect())) == sorted(map(tuple, ngram_counts(s, 3, tokens=table).collect()))


def test_supplied_entities(spark):
    s = sentences_df(spark, ["x y\nz\nw"])
    ents = spark.createDataFrame([(0, 0, "Paris"), (0, 1, "PARIS"), (0, 1, "Rome")],
                                 "problem_id long, sent_idx int, ent_text string")
    assert [r.ner_overlap_next for r in entity_overlap(s, ents).orderBy("sent_idx").collect()] == [0.5, 0.0, 0.0]


def test_lexicon_tables(spark):
    s = sentences_df(spark, ["grumbly people\nWho knows why"])
    senti = spark.createDataFrame([("grumbly", -0.8, 0.6)], "word string, polarity double, subjectivity double")
    easy = spark.createDataFrame([("people",), ("who",), ("why",)], "word string")
    f = {r.sent_idx: r for r in lexical_features(s, sentiment=senti, easy_words=easy).collect()}
    assert f[0].sentiment_polarity == -0.8 and f[1].sentiment_polarity == 0.0
    assert f[0].dale_chall_score == pytest.approx(0.1579 * 50 + 0.0496 * 2 + 3.6365)
    assert f[1].wh_word_ratio == pytest.approx(2 / 3)


def test_emoji_code_points(spark):
    yes = ["↔", "↙", "↩", "Ⓜ", "▪", "▶", "⤴", "⌚", "☀", "✅", "©", "™", "😀", "🇫", "🥇", "🫶"]
    no = ["⌀", "☆", "→", "─", "2", "#", "é", "∑", "⬀"]
    f = lexical_features(sentences_df(spark, ["\n".join(yes + no)])).orderBy("sent_idx").collect()
    assert [r.has_emoji for r in f] == [1] * len(yes) + [0] * len(no)
    assert len(lx.EMOJI_RANGES.split()) < 200
