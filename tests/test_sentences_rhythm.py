import numpy as np

from conftest import problems_df, sentences_df
from styloscope.operators.rhythm import pattern_blocks, rhythm, rhythm_pairs
from styloscope.operators.sentences import min_length_filter, pair_positions


def test_split_keeps_blank_lines_and_counts(spark):
    s = sentences_df(spark, ["a b.\n\nc d!", "single"]).orderBy("problem_id", "sent_idx").collect()
    assert [(r.problem_id, r.sent_idx, r.sentence, r.n_sentences) for r in s] == [
        (0, 0, "a b.", 3), (0, 1, "", 3), (0, 2, "c d!", 3), (1, 0, "single", 1)]


def test_min_length_and_pairs(spark):
    s = sentences_df(spark, ["x", "a\nb", "a\nb\nc", "a\nb\nc\nd"])
    assert {r.problem_id for r in min_length_filter(s).collect()} == {1, 2, 3}
    p = pair_positions(s).collect()
    per = {}
    for r in p:
        per.setdefault(r.problem_id, []).append((r.pair_idx, r.position_ratio))
    assert sorted(per[1]) == [(0, 0.0)]
    assert sorted(per[3]) == [(0, 0.0), (1, 1 / 3), (2, 2 / 3)]
    assert all(len(v) == [0, 1, 2, 3][k] for k, v in per.items())  # n - 1 pairs


def _ref_burst(sents, i):
    win = sents[max(0, i - 1): i + 2]
    marks = [c for s in win for c in s if c in "!?."]
    return len(set(marks)) / len(marks) if len(marks) > 1 else 0.0


def test_rhythm_matches_direct_definition(spark):
    texts = ["Hi! How are you? Fine.\nOk.\nReally?!\nNo...\nyes", "a\nb", "one line."]
    got = {(r.problem_id, r.sent_idx): r for r in rhythm(sentences_df(spark, texts)).collect()}
    for pid, t in enumerate(texts):
        sents = t.split("\n")
        for i in range(len(sents)):
            lens = [len(x) for x in sents[max(0, i - 1): i + 2]]
            var = float(np.var(lens)) if len(lens) > 1 else 0.0
            r = got[(pid, i)]
            assert abs(r.punctuation_burstiness - _ref_burst(sents, i)) < 1e-12
            assert abs(r.length_variance - var) < 1e-9
    d = {(r.problem_id, r.pair_idx) for r in rhythm_pairs(sentences_df(spark, texts)).collect()}
    assert d == {(0, i) for i in range(4)} | {(1, 0)}


def test_pattern_rules_and_blocks(spark):
    text = "\n".join([
        "r/something here", "Please review our rules today", "I am a bot, beep", "EDIT: fixed", "normal line",
        "Violations of rules happen", "Permanent ban incoming"])
    rows = sorted((r.sent_idx, r.pattern_type, r.pattern_same_block, r.pattern_block_start, r.pattern_block_end)
                  for r in pattern_blocks(sentences_df(spark, [text])).collect())
    assert [r[1] for r in rows] == [1, 2, 3, 4, 0, 2, 2]
    assert rows[5][2:] == (1, 1, 0) and rows[6][2:] == (0, 0, 1)
