"""Graphs as arrays of a row: against the table form of the same metrics, and windows against graphs of all their tokens."""

import random

import pytest
from pyspark.sql import functions as F

from styloscope.functions import arrays as ar
from styloscope.operators import adjacency as ad
from styloscope.operators import graphs as gr

KEY = ["problem_id", "sent_idx"]


def inputs(spark, texts, include_pos=True):
    rows = [(0, i, [w for w in t.split(" ") if w], include_pos) for i, t in enumerate(texts)]
    words = spark.createDataFrame(rows, "problem_id long, sent_idx int, words array<string>, include_pos boolean")
    return words.select("*", F.transform("words", lambda w: F.concat(F.lit("POS_"), F.upper(F.substring(w, -1, 1)))).alias("tags"))


def texts_of(n, seed=2):
    rng = random.Random(seed)
    words = "the cat runs and dog ran a . é 0 1 1a POS ha".split()
    return [" ".join(rng.choice(words[:rng.randint(1, len(words))]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


EDGE_CASES = ["", "one", "ha ha", "ha ha ha", "a b a b a", "a b c a", "x " * 500, " ".join(f"w{i % 61}" for i in range(900))]


@pytest.mark.parametrize("short, include_pos", [(2048, True), (0, False)])
def test_metrics_equal_the_table_form(spark, monkeypatch, short, include_pos):
    monkeypatch.setattr(ar, "SHORT", short)  # 0: every lookup by sorting
    data = inputs(spark, EDGE_CASES + texts_of(30), include_pos)
    edges, nodes = gr.build_wan(data, KEY)
    want = {r.sent_idx: r.asDict() for r in gr.wan_metrics(edges, nodes, KEY).collect()}
    got = {r.sent_idx: r.asDict() for r in ad.metrics(ad.graph_rows(data, KEY), KEY).collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        for name, value in row.items():
            assert got[k][name] == (value if value is None else pytest.approx(value, abs=1e-9)), (k, name)
    table = ad.edge_table(ad.graph_rows(data, KEY), KEY)
    columns = ["sent_idx", "src", "dst", "weight", "edge_type"]
    assert sorted(map(tuple, table.select(columns).collect())) == sorted(map(tuple, edges.select(columns).collect()))


@pytest.mark.parametrize("short", [2048, 0])
def test_joined_graphs_equal_graphs_of_all_tokens(spark, monkeypatch, short):
    monkeypatch.setattr(ar, "SHORT", short)
    texts = EDGE_CASES[:6] + texts_of(20, 7)
    groups = [texts[i:i + 3] for i in range(len(texts) - 2)] + [["", "", ""], ["", "a", ""], ["a", "", "a"]]
    wide = spark.createDataFrame([(0, i, *g) for i, g in enumerate(groups)], "problem_id long, sent_idx int, a string, b string, c string")
    parts = [ad.graph_rows(inputs(spark, [g[k] for g in groups]), KEY).withColumnRenamed("graph", f"g{k}") for k in range(3)]
    rows = wide.select(*KEY)
    for p in parts:
        rows = rows.join(p, KEY)
    merged = rows.select(*KEY, ad.joined(F.array("g0", "g1", "g2")).alias("graph"))
    whole = ad.graph_rows(inputs(spark, [" ".join(x for x in g if x) for g in groups]), KEY)
    shape = ["sent_idx", "graph.nodes", "graph.edges", "graph.weights", "graph.n_tokens"]
    got = {r[0]: r[1:] for r in merged.select(shape).collect()}
    want = {r[0]: r[1:] for r in whole.select(shape).collect()}
    assert got == want


def test_pairwise_equals_the_table_form(spark):
    data = inputs(spark, EDGE_CASES + texts_of(25, 4))
    edges, nodes = gr.build_wan(data, KEY)
    want = {r.pair_idx: r[2:] for r in gr.wan_pairwise(edges, nodes).orderBy("pair_idx").collect()}
    got = {r.pair_idx: r[2:] for r in ad.pairwise(ad.with_next(ad.graph_rows(data, KEY))).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_path_summaries_and_cosines_equal_the_table_form(spark):
    from styloscope.operators import paths as pa
    data = inputs(spark, EDGE_CASES[:6] + texts_of(12, 9))
    edges, nodes = gr.build_wan(data, KEY)
    cent = pa.node_centralities(edges, nodes, KEY)
    want = {r.sent_idx: r.asDict() for r in pa.centrality_summaries(cent, KEY).collect()}
    rows = ad.graph_rows(data, KEY).withColumn("kept", F.col("graph"))
    found = pa.centrality_rows(rows, arrays=("closeness", "eigenvector"))
    got = {r.sent_idx: r.asDict() for r in found.collect() if r.closeness_centrality_mean is not None}
    assert set(got) == set(want)
    for k, row in want.items():
        for name, value in row.items():
            assert got[k][name] == pytest.approx(value, abs=1e-9), (k, name)
    both = ("closeness", "eigenvector")
    table = gr.wan_pairwise(edges, nodes, node_values=pa.pairwise_path_cosines(cent))
    want = {r.pair_idx: (r.closeness_cosine, r.eigenvector_cosine) for r in table.collect()}
    rows = pa.pair_values(found).withColumnRenamed("kept", "graph").select(*KEY, "graph", *both)
    pairs = ad.pairwise(ad.with_next(rows, both), both).collect()
    got = {r.pair_idx: (r.closeness_cosine, r.eigenvector_cosine) for r in pairs}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_metrics_need_no_exchange(spark):
    rows = ad.graph_rows(inputs(spark, ["a b c"]), KEY)
    assert "Exchange" not in ad.metrics(rows, KEY)._jdf.queryExecution().toString()


def test_nodes_carry_the_tag_of_their_last_occurrence(spark):
    rows = [(0, 0, ["run", "the", "run"], ["POS_NOUN", "POS_DET", "POS_VERB"], True), (0, 1, ["a", "b"], ["POS_X", "POS_Y"], False),
            (0, 2, ["one"], ["POS_NUM"], True), (0, 3, [], [], True), (0, 4, ["é"] * 3, ["POS_B", "POS_C", "POS_A"], True)]
    norm = spark.createDataFrame(rows, "problem_id long, sent_idx int, words array<string>, tags array<string>, include_pos boolean")
    got = sorted((tuple(r[1:]) for r in ad.node_table(norm, KEY).collect()), key=lambda x: (x[0], x[1]))
    assert got == sorted([
        (0, "run", "word", "VERB"), (0, "the", "word", "DET"), (0, "POS_NOUN", "POS", None), (0, "POS_DET", "POS", None),
        (0, "POS_VERB", "POS", None), (1, "a", "word", None), (1, "b", "word", None), (4, "é", "word", "A"),
        (4, "POS_A", "POS", None), (4, "POS_B", "POS", None), (4, "POS_C", "POS", None)], key=lambda x: (x[0], x[1]))


@pytest.mark.parametrize("include_pos", [True, False])
def test_words_give_what_their_graphs_give(spark, include_pos):
    from styloscope.operators import paths as pa
    data = inputs(spark, EDGE_CASES + texts_of(20, 6)).withColumn("include_pos", F.lit(include_pos))
    graphs = ad.graph_rows(data, KEY)
    values = ("closeness", "eigenvector")

    def found(rows, kept):
        paths = pa.centrality_rows(rows.withColumn("kept", kept), arrays=values)
        pairs = ad.with_next(paths.select(*KEY, *values, *(["kept.*"] if "words" in rows.columns else
                                                           [F.col("kept").alias("graph")])), values)
        return [{r[:2]: r[2:] for r in df.collect()} for df in (
            ad.metrics(rows, KEY), ad.metrics(rows, KEY, every_row=True), paths.drop("kept"), ad.pairwise(pairs, values))]

    assert found(data, F.struct("words", "tags", "include_pos")) == found(graphs, F.col("graph"))


def test_metrics_of_words_build_no_graph_in_the_row(spark):
    plan = ad.metrics(inputs(spark, ["a b c"]), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_position" not in plan
