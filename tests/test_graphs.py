import math
import random
from collections import Counter

from styloscope.operators.graphs import KEY, build_wan, wan_metrics, wan_pairwise


def graphs_df(spark, word_lists, include_pos=False):
    from pyspark.sql import functions as F
    from styloscope.operators.graphs import graph_inputs
    rows = [(0, i, w, include_pos) for i, w in enumerate(word_lists)]
    df = spark.createDataFrame(rows, "problem_id long, sent_idx int, norm_tokens array<string>, include_pos boolean")
    return graph_inputs(df, KEY)


def py_graph(words):
    if len(words) < 2:
        return set(), set()
    return set(words), {(a, b) for a, b in zip(words, words[1:]) if a != b}


def py_metrics(words):
    nodes, edges = py_graph(words)
    v, e = len(nodes), len(edges)
    if v == 0:
        return None
    indeg, outdeg = Counter(b for _, b in edges), Counter(a for a, _ in edges)
    deg = {n: indeg[n] + outdeg[n] for n in nodes}
    und = {tuple(sorted(x)) for x in edges}
    nb = {n: set() for n in nodes}
    for a, b in und:
        nb[a].add(b)
        nb[b].add(a)
    cl = []
    tri = 0
    for n in nodes:
        k = len(nb[n])
        t = sum(1 for a in nb[n] for b in nb[n] if a < b and (min(a, b), max(a, b)) in und)
        tri += t
        cl.append(2 * t / (k * (k - 1)) if k >= 2 else 0.0)
    xs = [outdeg[a] for a, _ in edges]
    ys = [indeg[b] for _, b in edges]
    if v <= 1:
        assort = 0.0
    elif not edges:
        assort = None
    else:
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        sx = math.sqrt(sum((x - mx) ** 2 for x in xs) / len(xs))
        sy = math.sqrt(sum((y - my) ** 2 for y in ys) / len(ys))
        cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / len(xs)
        assort = None if sx * sy == 0 else cov / (sx * sy)
    hist = Counter(deg.values())
    ent = -sum(c / v * math.log(c / v) for c in hist.values())
    return dict(V=v, E=e, average_degree=2 * e / v, density=e / (v * (v - 1)) if v > 1 else 0.0,
                average_clustering=sum(cl) / v if v > 1 else 0.0, assortativity=assort, degree_entropy=ent,
                triangle_count=tri // 3, star_ratio=sum(1 for d in deg.values() if d >= 3) / v)


def test_metrics_match_brute_force(spark):
    random.seed(3)
    vocab = list("abcdefg")
    lists = [[random.choice(vocab) for _ in range(random.randint(0, 14))] for _ in range(40)]
    lists += [["ha", "ha"], ["solo"], []]
    edges, nodes = build_wan(graphs_df(spark, lists), KEY)
    got = {r.sent_idx: r.asDict() for r in wan_metrics(edges, nodes, KEY).collect()}
    for i, words in enumerate(lists):
        want = py_metrics(words)
        if want is None:
            assert i not in got
            continue
        g = got[i]
        for k, v in want.items():
            if v is None:
                assert g[k] is None, (i, k)
            else:
                assert abs(g[k] - v) < 1e-9, (i, k, g[k], v)


def test_self_loop_keeps_node(spark):
    edges, nodes = build_wan(graphs_df(spark, [["ha", "ha"]]), KEY)
    assert edges.count() == 0 and [r.node for r in nodes.collect()] == ["ha"]


def test_pos_nodes_and_edges(spark):
    edges, nodes = build_wan(graphs_df(spark, [["the", "cat", "runs", "quickly"]], include_pos=True), KEY)
    types = Counter(r.node_type for r in nodes.collect())
    assert types["word"] == 4 and types["POS"] >= 3
    pos_edges = [r for r in edges.collect() if r.edge_type == "pos_pos"]
    assert all(r.src.startswith("POS_") and r.dst.startswith("POS_") for r in pos_edges)


def test_pairwise_jaccard(spark):
    lists = [["a", "b", "c"], ["b", "c", "d"], ["x"]]
    edges, nodes = build_wan(graphs_df(spark, lists), KEY)
    rows = {r.pair_idx: r for r in wan_pairwise(edges, nodes).collect()}
    assert set(rows) == {0}                      # graph 2 is empty (one token): no pair features
    assert abs(rows[0].node_jaccard - 2 / 4) < 1e-12
    assert abs(rows[0].edge_jaccard - 1 / 3) < 1e-12
