import random
from collections import deque

import numpy as np
import pytest

import styloscope.operators.paths as P


def brute(nodes, edges):
    nodes = sorted(set(nodes))
    n = len(nodes)
    succ = {v: [] for v in nodes}
    pred = {v: [] for v in nodes}
    for a, b in edges:
        succ[a].append(b)
        pred[b].append(a)

    def bfs(s, nb):
        d = {s: 0}
        q = deque([s])
        while q:
            u = q.popleft()
            for w in nb[u]:
                if w not in d:
                    d[w] = d[u] + 1
                    q.append(w)
        return d

    def npaths(s):
        d = bfs(s, succ)
        sig = {s: 1}
        for v in sorted(d, key=d.get):
            if v != s:
                sig[v] = sum(sig[p] for p in pred[v] if p in d and d[p] == d[v] - 1)
        return d, sig

    close = {}
    for u in nodes:
        d = bfs(u, pred)
        tot, r = sum(d.values()), len(d)
        close[u] = ((r - 1) / tot) * ((r - 1) / (n - 1)) if tot > 0 and n > 1 else 0.0
    btw = {v: 0.0 for v in nodes}
    info = {s: npaths(s) for s in nodes}
    for s in nodes:
        ds, ss = info[s]
        for t in ds:
            for v in ds:
                if v in (s, t) or t == s:
                    continue
                dv, sv = info[v]
                if t in dv and ds[v] + dv[t] == ds[t]:
                    btw[v] += ss[v] * sv[t] / ss[t]
    if n > 2:
        btw = {k: x / ((n - 1) * (n - 2)) for k, x in btw.items()}
    x = {v: 1.0 / n for v in nodes}
    for _ in range(100000):
        last = dict(x)
        for a, b in edges:
            x[b] += last[a]
        nrm = sum(v * v for v in x.values()) ** 0.5 or 1
        x = {k: v / nrm for k, v in x.items()}
        if sum(abs(x[k] - last[k]) for k in x) < n * 1e-6:
            break
    return nodes, btw, close, x


@pytest.mark.parametrize("cells", [P.BLOCK_CELLS, 1])  # all sources in one block, and one source at a time
def test_kernel_matches_brute_force(monkeypatch, cells):
    monkeypatch.setattr(P, "BLOCK_CELLS", cells)
    random.seed(11)
    for _ in range(40):
        n = random.randint(1, 10)
        nodes = [f"w{i}" for i in range(n)]
        edges = sorted({(random.choice(nodes), random.choice(nodes)) for _ in range(random.randint(0, 25))})
        edges = [e for e in edges if e[0] != e[1]]
        want = brute(nodes, edges)
        names, b, c, e, _, ok = P.graph_centralities(nodes, [a for a, _ in edges], [y for _, y in edges], 100000)
        assert ok and names == want[0]
        assert np.allclose(b, [want[1][v] for v in names], atol=1e-9)
        assert np.allclose(c, [want[2][v] for v in names], atol=1e-9)
        assert np.allclose(e, [want[3][v] for v in names], atol=1e-9)


def test_only_the_metrics_asked_for():
    _, b, c, e, _, _ = P.graph_centralities(["a", "b"], ["a"], ["b"], metrics=("closeness",))
    assert b is None and e is None and c.tolist() == [0.0, 1.0]


def test_streamed_kernel_on_spark(spark):
    from styloscope.operators.paths import centrality_summaries, node_centralities
    nodes = spark.createDataFrame([(0, 0, v) for v in "abc"] + [(0, 1, "z")],
                                  "problem_id long, sent_idx int, node string")
    edges = spark.createDataFrame([(0, 0, "a", "b"), (0, 0, "b", "c")],
                                  "problem_id long, sent_idx int, src string, dst string")
    cent = {(r.sent_idx, r.node): r for r in node_centralities(edges, nodes, ["problem_id", "sent_idx"]).collect()}
    assert abs(cent[(0, "b")].betweenness - 0.5) < 1e-12      # path a->b->c, scaled by 1/((3-1)(3-2))
    assert abs(cent[(0, "c")].closeness - 2 / 3) < 1e-12        # ((3-1)/3) * ((3-1)/(3-1))
    s = {r.sent_idx for r in centrality_summaries(node_centralities(edges, nodes, ["problem_id", "sent_idx"]),
                                                  ["problem_id", "sent_idx"]).collect()}
    assert s == {0}                                            # single-node graph gets no path metrics


@pytest.mark.parametrize("cells", [P.BLOCK_CELLS, 300, 1])  # many graphs at a time, a few, and parts of one
def test_many_graphs_at_once_equal_one_by_one(monkeypatch, cells):
    from styloscope.operators.graph_arrays import Graphs
    monkeypatch.setattr(P, "BLOCK_CELLS", cells)
    random.seed(5)
    sizes = [1, 2, 3, 9, 64, 65, 140, 20, 7]
    graphs = []
    for n in sizes:
        walk = [min(n - 1, int(random.random() ** 2 * n)) for _ in range(2 * n)]
        graphs.append((n, sorted({(a, b) for a, b in zip(walk, walk[1:]) if a != b})))
    ends = [np.array([x[k] for _, e in graphs for x in e], np.int64) for k in (0, 1)]
    g = Graphs(np.array(sizes), np.array([len(e) for _, e in graphs]), *ends)
    found, iters, ok = P.centralities(g, 100000, P.METRICS)
    assert ok.all()
    for i, (n, edges) in enumerate(graphs):
        names = [f"{v:03d}" for v in range(n)]
        nodes, *want = brute(names, [(names[a], names[b]) for a, b in edges])
        for metric, values in zip(P.METRICS, want):
            assert np.allclose(found[metric][g.off[i]:g.off[i + 1]], [values[v] for v in nodes], atol=1e-9), (metric, n)
        assert iters[i] == P.graph_centralities(nodes, [names[a] for a, _ in edges], [names[b] for _, b in edges])[4]


def test_eigenvector_stops_at_its_limit_per_graph():
    from styloscope.operators.graph_arrays import Graphs
    chain = np.arange(30)
    g = Graphs(np.array([2, 31]), np.array([0, 30]), chain, chain + 1)
    values, iters, ok = P.eigenvectors(g, 5)
    assert iters.tolist() == [2, 5] and ok.tolist() == [True, False] and values[2:].any()


def test_batches_are_cut_into_slices(spark, monkeypatch):
    import pyarrow as pa

    from styloscope.operators import graph_arrays as ga
    monkeypatch.setattr(ga, "SLICE_CELLS", 4)
    e = [[0 << 31 | 1, 2 << 31 | 0], [], None, [0 << 31 | 1]]
    nodes = [["0a", "0b", "1X"], ["0a"], None, ["0c", "0d"]]
    packed = pa.StructArray.from_arrays([pa.array(nodes), pa.array([4, 1, None, 2], pa.int32()),
                                         pa.array(e, pa.list_(pa.int64())),
                                         pa.array([x and [1] * len(x) for x in e], pa.list_(pa.int32()))],
                                        ["nodes", "t", "e", "w"])
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12, 13]), packed], names=["key", "_g"])
    measure = lambda g: {"edges": g.e}
    for every_row, want in ((True, [(10, 2), (11, None), (12, None), (13, 1)]), (False, [(10, 2), (13, 1)])):
        parts = list(ga.measured(batch, {"edges": pa.int64()}, every_row, measure))
        assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want and len(parts) > 1
