import numpy as np

from styloscope.llm import language_id as li

EN = "the cat sat on the mat and then it went to the house with all of the others "
DE = "der hund und die katze sind nicht in dem haus weil sie auf der strasse spielen "


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = li.held_out_languages(docs).collect()
    assert len(rows) == len(labels)
    held = [r for r in rows if r.held_out]
    import zlib
    assert {r.doc_id for r in held} == {d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == labels[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_prediction_uses_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = li.learn(docs)
    one = {r.doc_id: r.lang_pred for r in li.predict(docs, *model).collect()}
    other = {r.doc_id - 5: r.lang_pred for r in li.predict(docs.selectExpr("doc_id + 5 AS doc_id", "text"), *model).collect()}
    assert one == other


def test_edges_and_mixtures(spark):
    rows = [(k, EN * 3, "en") for k in range(5)] + [(k + 10, DE * 3, "de") for k in range(5)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "123 !? 😀", None), (23, EN * 4 + DE * 4, None), (24, DE, None),
             (None, EN, None), (25, "the", "en"), (26, EN * 500, None), (24, DE, None)]
    docs = spark.createDataFrame([(d, t, x, 0.5) for d, t, x in rows], "doc_id long, text string, lang string, score double")
    from pyspark.sql import functions as F
    got = [r for r in li.identify(docs, F.lit(True)).collect()]
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (20, 21, 22)] == ["und"] * 3 and by_id[22].score == 0
    assert by_id[24].lang_pred == "de" and by_id[None].lang_pred == by_id[25].lang_pred == by_id[26].lang_pred == "en"
    shares = {x.lang: x.share for x in by_id[23].shares}
    assert set(shares) == {"en", "de"} and all(0.3 < v < 0.7 for v in shares.values())


def test_mixture_is_the_likeliest():
    """EM's proportions against a grid over the two languages."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(50, 0.3), 2).T + 1e-6
    log_p = np.full((li.BUCKETS, 2), -30.0, np.float32)
    log_p[:50] = np.log(p / p.sum(axis=0))
    for share in (0.25, 0.5, 0.8):
        grams = rng.choice(50, 4000, p=(p / p.sum(axis=0)) @ [share, 1 - share]).astype(np.uint32)
        counts = np.bincount(grams, minlength=50)
        grid = np.linspace(0, 1, 1001)
        best = grid[np.argmax([counts @ np.log(np.exp(log_p[:50]) @ [g, 1 - g]) for g in grid])]
        assert abs(li.mixture(grams, log_p)[0] - best) < 0.02


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[:4] for r in li.held_out_languages(docs).collect()] == [(1, False, "und", 0.0)]
    assert li.held_out_languages(docs.limit(0)).collect() == []
