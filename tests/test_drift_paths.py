"""The pair tables of the queries compare windows over all 30 graph features."""

import pytest

from styloscope.plans import features, registry


class Reached(Exception):
    pass


@pytest.mark.parametrize("build", ["q_style_change_features", "_stitched_pairs"])
def test_pair_table_drift_has_path_features(spark, monkeypatch, build):
    asked = []

    def drift(_spark, _sentences, *args, with_paths=True, **kwargs):
        asked.append(with_paths)
        raise Reached

    monkeypatch.setattr("styloscope.operators.drift.wan_window_drift", drift)
    monkeypatch.setattr("styloscope.operators.adjacency.pairwise", lambda *a: None)
    monkeypatch.setattr("styloscope.operators.adjacency.with_next", lambda *a: None)
    monkeypatch.setattr("styloscope.operators.paths.pair_values", lambda rows: rows)
    monkeypatch.setattr(features, "store", lambda df, name: df)
    columns = "problem_id long, sent_idx int, graph int, closeness double, eigenvector double"
    monkeypatch.setattr(features, "_graph_features", lambda *a, **k: spark.createDataFrame([], columns))
    monkeypatch.setattr(features, "full_sentence_features", lambda spark, sentences, *a: sentences)
    with pytest.raises(Reached):
        getattr(registry, build)(spark, "/root/testdata/sf0.001")
    assert asked == [True]
