import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from styloscope.operators.sequence import framed, with_neighbours
from styloscope.operators.vectors import directional_cosine, embedding_pairs, multi_skip_drift, neighbour_cosine, \
    neighbour_vectors


def test_neighbours_and_frames_match_window_functions(spark):
    random.seed(5)
    rows = [(p, i, float(random.randint(0, 9))) for p in range(6) for i in range(random.randint(1, 7))]
    df = spark.createDataFrame(rows, "problem_id long, sent_idx int, x double")
    w = Window.partitionBy("problem_id").orderBy("sent_idx")
    want = {(r.problem_id, r.sent_idx): r for r in df.select(
        "problem_id", "sent_idx", F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("n"),
        F.lead("x", 2).over(w).alias("n2"), F.sum("x").over(w.rowsBetween(-1, 1)).alias("s"),
        F.count(F.lit(1)).over(w.rowsBetween(-1, 1)).alias("c")).collect()}
    nb = {(r.problem_id, r.sent_idx): r for r in with_neighbours(df, ["problem_id"], "sent_idx", ["x"], [-1, 1, 2]).collect()}
    fr = {(r.problem_id, r.sent_idx): r for r in framed(df, ["problem_id"], "sent_idx", -1, 1,
                                                           [F.sum("x").alias("s"), F.count(F.lit(1)).alias("c")]).collect()}
    assert set(nb) == set(want) == set(fr)
    for k, r in want.items():
        assert (nb[k].x_prev, nb[k].x_next, nb[k].x_next2) == (r.p, r.n, r.n2)
        assert (fr[k].s, fr[k].c) == (r.s, r.c)


def emb_df(spark, vecs):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(vecs)],
                                 "problem_id long, sent_idx int, embedding array<float>")


def test_vectors_of_pairs_are_repaired(spark):
    from styloscope.operators.pairs import fill_numeric
    from styloscope.operators.vectors import vector_pairs

    nan, inf = float("nan"), float("inf")
    e = emb_df(spark, [[1.0, nan, 2.0], [3.0, 1.0, inf], [0.5, None, -inf]])
    got = {r.pair_idx: r for r in vector_pairs(neighbour_vectors(e, (1,))).collect()}
    assert sorted(got) == [0, 1]
    assert got[0].f1_sbert == [1.0, 0.0, 2.0] and got[0].f2_sbert == [3.0, 1.0, 0.0]
    assert got[0].delta_sbert == [2.0, 0.0, 0.0]
    assert got[1].f2_sbert == [0.5, 0.0, 0.0] and got[1].delta_sbert == [-2.5, 0.0, 0.0]
    filled = fill_numeric(emb_df(spark, [[nan, 1.0], None])).orderBy("sent_idx").collect()
    assert [r.embedding for r in filled] == [[0.0, 1.0], None]


def test_zero_vectors_and_edges(spark):
    e = emb_df(spark, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])
    nb = neighbour_vectors(e)
    pairs = {r.pair_idx: r for r in embedding_pairs(nb).collect()}
    assert pairs[0].sbert_cosine_similarity == 0.0 and pairs[0].sbert_norm_ratio == 0.0
    assert abs(pairs[1].sbert_euclidean - 1.0) < 1e-12 and abs(pairs[1].sbert_manhattan - 1.0) < 1e-12
    d = {r.pair_idx: r.sbert_directional_cosine for r in directional_cosine(nb).collect()}
    assert d[2] == 0.0 and abs(d[1] - 0.0) < 1e-12     # (0,1) . (-1,0) = 0 ; last pair defaults to 0
    m = {r.pair_idx: r for r in multi_skip_drift(nb).collect()}
    assert m[2].semantic_drift_distance_skip2 is None and m[0].semantic_drift_cosine_skip3 == 0.0
    nc = {r.sent_idx: r.avg_sbert_cosine_neighbors for r in neighbour_cosine(nb).collect()}
    assert nc[0] == 0.0 and nc[3] == 0.0 and abs(nc[2] - (2 ** -0.5 + 2 ** -0.5) / 2) < 1e-12
