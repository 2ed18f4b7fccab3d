"""Betweenness, closeness and eigenvector centrality per graph.

Exact path metrics need a whole graph in one place, so this is a family that runs a kernel, on many graphs at once
(``graph_arrays.Graphs``): a task turns the graphs of a batch into rows without numpy calls per graph. A graph is bounded
by one sentence (or window of sentences).

Searches are level-synchronous, for the sources of as many graphs, or of as large a part of one graph, as hold about
``BLOCK_CELLS`` numbers, so memory does not grow with the batch and is linear in nodes + edges for one graph. Distances are
searched for 64 sources at a time, one bit each: a level is one OR over the edges. Path counts go along the edges out of the
nodes found last, and back over the same steps.

Definitions (directed, unweighted):
* closeness(u) uses distances *into* u: with r nodes reaching u (u included) and total distance T,
  ((r-1)/T) * ((r-1)/(V-1)), 0 when T = 0;
* betweenness is Brandes' shortest-path dependency sum, scaled by 1/((V-1)(V-2)) when V > 2;
* eigenvector iterates x <- x + A^T x from the uniform vector, L2-normalised, until the L1 change
  is below V * 1e-6 (``max_iter`` caps it; ``converged`` reports the outcome).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from styloscope.operators.graph_arrays import Graphs, heads, measured, others, packed, ranges, slices

BLOCK_CELLS = 1 << 17
TOL = 1e-6
METRICS = ("betweenness", "closeness", "eigenvector")
WORD_BITS = 64
#: Levels between two looks for graphs whose search has ended.
LOOK = 16


def distances(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """Per node: total distance from the nodes that reach it, and their number (itself included)."""
    total, reached = np.zeros(len(g.gid), np.int64), np.zeros(len(g.gid), np.int64)
    by_dst = np.argsort(g.dst, kind="stable")
    src, dst = g.src[by_dst], g.dst[by_dst]
    blocks = -(-g.n // WORD_BITS)
    of, block = np.repeat(np.arange(g.size), blocks), ranges(np.zeros(g.size, np.int64), blocks)
    for first, last in slices(g.n[of] + g.e[of], BLOCK_CELLS):
        graphs = of[first:last]
        size = g.n[graphs]
        base = np.cumsum(size) - size
        node, edge = ranges(g.off[graphs], size), ranges(g.e_off[graphs], g.e[graphs])
        shift = np.repeat(base - g.off[graphs], g.e[graphs])
        s, d = src[edge] + shift, dst[edge] + shift
        place = ranges(np.zeros(len(graphs), np.int64), size)
        here = place // WORD_BITS == np.repeat(block[first:last], size)
        found = np.where(here, np.uint64(1) << (place % WORD_BITS).astype(np.uint64), np.uint64(0))
        seen, away, at, level = found.copy(), np.zeros(len(node), np.int64), None, 0
        part = np.repeat(np.arange(len(graphs)), size)
        while True:
            bits = found[s]
            live = np.flatnonzero(bits)
            if not len(live):
                break
            if level % LOOK == LOOK - 1:  # only the edges of graphs that are still searched
                going = np.zeros(len(graphs), bool)
                going[part[s[live]]] = True
                keep = going[part[s]]
                s, d, bits = s[keep], d[keep], bits[keep]
                live = np.flatnonzero(bits)
            ends = d[live]
            first_of = heads(ends)
            target = ends[first_of]
            new = np.bitwise_or.reduceat(bits[live], first_of) & ~seen[target]
            if at is None:
                found[:] = 0
            else:
                found[at] = 0
            at, level = target, level + 1
            found[at] = new
            seen[at] |= new
            away[at] += level * np.bitwise_count(new).astype(np.int64)
        np.add.at(total, node, away)
        np.add.at(reached, node, np.bitwise_count(seen).astype(np.int64))
    return total, reached


def dependencies(g: Graphs) -> np.ndarray:
    """Per node: the sum over all sources of Brandes' dependency on it, the source's own left out."""
    sums, degree = np.zeros(len(g.gid)), np.bincount(g.src, minlength=len(g.gid))
    start = np.cumsum(degree) - degree
    dst = g.dst[np.argsort(g.src, kind="stable")]
    for first, last in slices((g.n + g.e)[g.gid], BLOCK_CELLS):
        graphs = g.gid[first:last]
        size = g.n[graphs]
        base = np.cumsum(size) - size
        node = ranges(g.off[graphs], size)
        cells = len(node)
        paths, dist, mark = np.zeros(cells), np.full(cells, -1, np.int32), np.zeros(cells, np.int64)
        sources = base + np.arange(first, last) - g.off[graphs]
        paths[sources], dist[sources] = 1.0, 0
        front, steps = sources, []
        while len(front):
            at = node[front]
            out = degree[at]
            begun = np.repeat(front, out)
            ended = dst[ranges(start[at], out)] - np.repeat(at - front, out)
            new = dist[ended] < 0
            begun, ended = begun[new], ended[new]
            np.add.at(paths, ended, paths[begun])
            dist[ended] = len(steps) + 1
            order = np.arange(len(ended))
            mark[ended] = order
            front = ended[mark[ended] == order]
            if len(ended):
                steps.append((begun, ended))
        delta = np.zeros(cells)
        for begun, ended in reversed(steps):
            share = (1.0 + delta[ended]) / paths[ended]
            first_of = heads(begun)
            back = begun[first_of]
            delta[back] += paths[back] * np.add.reduceat(share, first_of)
        delta[sources] = 0.0
        low = g.off[graphs[0]]
        found = np.bincount(node - low, delta)
        sums[low:low + len(found)] += found
    return sums


def eigenvectors(g: Graphs, max_iter: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node the value; per graph the iterations and whether they converged. Graphs that have are left out of the
    iteration as soon as they are a quarter of those in it."""
    value, iterations, converged = np.zeros(len(g.gid)), np.full(g.size, max_iter), np.zeros(g.size, bool)
    live, n, src, dst = np.arange(g.size), g.n, g.src, g.dst
    at, gid, starts = np.arange(len(g.gid)), g.gid, g.off[:-1]
    x, ended = 1.0 / n[gid], np.zeros(len(live), bool)
    for it in range(1, max_iter + 1):
        last = x
        x = last + np.bincount(dst, weights=last[src], minlength=len(last))
        length = np.sqrt(np.add.reduceat(x * x, starts))
        length[length == 0] = 1.0
        x /= length[gid]
        done = (np.add.reduceat(np.abs(x - last), starts) < n * TOL) & ~ended
        if not done.any():
            continue
        cells = ranges(starts[done], n[done])
        value[at[cells]] = x[cells]
        iterations[live[done]], converged[live[done]] = it, True
        ended |= done
        if ended.all():
            return value, iterations, converged
        if ended.sum() * 4 >= len(ended):
            kept, edges = ~ended[gid], ~ended[gid[src]]
            moved = np.cumsum(kept) - 1
            src, dst = moved[src[edges]], moved[dst[edges]]
            x, at, live, n = x[kept], at[kept], live[~ended], n[~ended]
            gid, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            ended = np.zeros(len(live), bool)
    cells = ~ended[gid]
    value[at[cells]] = x[cells]
    return value, iterations, converged


def centralities(g: Graphs, max_iter: int, metrics) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The values per node of each metric asked for, the iterations of the eigenvectors and whether they converged."""
    found, iterations, converged = {}, np.zeros(g.size, np.int64), np.ones(g.size, bool)
    rest = np.maximum(g.n - 1, 1)[g.gid]
    if "betweenness" in metrics:
        n = g.n[g.gid]
        found["betweenness"] = dependencies(g) / np.where(n > 2, (n - 1) * (n - 2), 1)
    if "closeness" in metrics:
        total, reached = distances(g)
        with np.errstate(divide="ignore", invalid="ignore"):
            found["closeness"] = np.where(total > 0, ((reached - 1) / total) * ((reached - 1) / rest), 0.0)
    if "eigenvector" in metrics:
        found["eigenvector"], iterations, converged = eigenvectors(g, max_iter)
    return found, iterations, converged


def graph_centralities(nodes: list[str], src_names, dst_names, max_iter: int = 50_000_000, metrics=METRICS):
    """(nodes sorted, betweenness, closeness, eigenvector, iterations, converged) of one directed graph.

    A metric that is not asked for is None.
    """
    names = sorted(set(nodes))
    pos = {v: i for i, v in enumerate(names)}
    ends = np.array(sorted((pos[a], pos[b]) for a, b in zip(src_names, dst_names)), np.int64).reshape(-1, 2)
    g = Graphs(np.array([len(names)]), np.array([len(ends)]), ends[:, 0], ends[:, 1])
    found, iters, ok = centralities(g, max_iter, metrics)
    return (names, *[found.get(m) for m in METRICS], int(iters[0]), bool(ok[0]))


def node_centralities(edges: DataFrame, nodes: DataFrame, keys: list[str], max_iter: int = 50_000_000,
                      metrics=METRICS) -> DataFrame:
    """(keys, node, betweenness, closeness, eigenvector, eig_iterations, converged) per graph node.

    Only the ``metrics`` asked for are computed; the others are null.
    """
    types = dict(nodes.dtypes)
    key_ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    key_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out_schema = pa.schema([(k, key_arrow[types[k]]) for k in keys] + [
        ("node", pa.string()), ("betweenness", pa.float64()), ("closeness", pa.float64()),
        ("eigenvector", pa.float64()), ("eig_iterations", pa.int32()), ("converged", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, ends, out, size = None, [], [], [[] for _ in out_schema], 0

        def close() -> None:
            nonlocal size
            order, btw, near, eig, iters, ok = graph_centralities(
                names, [a for a, _ in ends], [b for _, b in ends], max_iter, metrics)
            n = len(order)
            columns = [[k] * n for k in held] + [order] + [
                [None] * n if x is None else x.tolist() for x in (btw, near, eig)] + [[iters] * n, [bool(ok)] * n]
            for whole, part in zip(out, columns):
                whole.extend(part)
            size += n

        def flush() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, out_schema)], schema=out_schema)
            for c in out:
                c.clear()
            size = 0
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key, (node, src, dst) = row[:len(keys)], row[len(keys):]
                if key != held:
                    if names:
                        close()
                    if size >= 8192:
                        yield flush()
                    held, names, ends = key, [], []
                if node is None:
                    ends.append((src, dst))
                else:
                    names.append(node)
        if names:
            close()
        if size:
            yield flush()

    none = F.lit(None).cast("string")
    rows = (nodes.select(*keys, "node", none.alias("src"), none.alias("dst"))
            .unionByName(edges.select(*keys, none.alias("node"), "src", "dst")))
    return (rows.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, f"{key_ddl}, node string, betweenness double, closeness double, eigenvector double, "
                             f"eig_iterations int, converged boolean"))


def centrality_rows(rows: DataFrame, metrics=METRICS, arrays: tuple[str, ...] = (),
                    max_iter: int = 50_000_000) -> DataFrame:
    """G18 on graph rows (``adjacency``): the columns of ``rows`` but the graph's, and for each metric its mean, population
    standard deviation, max and min over the nodes, and eigenvector_converged.

    Graphs of fewer than two nodes or tokens get nulls. ``arrays`` names metrics whose values per node are added as well
    (``eigenvector`` with eig_iterations). A row in, a row out: no shuffle, and node names stay in the JVM.
    """
    kept = others(rows)
    names = [f"{m}_centrality_{x}" for m in metrics for x in ("mean", "std", "max", "min")]
    added = ([(n, "double", pa.float64()) for n in names]
             + [("eigenvector_converged", "boolean", pa.bool_())] * ("eigenvector" in metrics)
             + [(m, "array<double>", pa.list_(pa.float64())) for m in arrays]
             + [("eig_iterations", "int", pa.int32())] * ("eigenvector" in arrays))

    def measure(g: Graphs) -> dict[str, object]:
        per_node, iters, ok = centralities(g, max_iter, metrics)
        values, several = {"eigenvector_converged": ok, "eig_iterations": iters.astype(np.int32)}, g.n >= 2
        for m in metrics:
            x, starts = per_node[m], g.off[:-1]
            mean = g.sums(x) / g.n
            away = x - mean[g.gid]
            for name, found in (("mean", mean), ("std", np.sqrt(g.sums(away * away) / g.n)),
                                ("max", np.maximum.reduceat(x, starts)), ("min", np.minimum.reduceat(x, starts))):
                values[f"{m}_centrality_{name}"] = found
        for m in arrays:
            values[m] = pa.ListArray.from_arrays(pa.array(g.off, pa.int32()), pa.array(per_node[m]))
        return {c: v if several.all() else _nulled(v, t, several) for (c, _, t), v in ((a, values[a[0]]) for a in added)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from measured(batch, {c: t for c, _, t in added}, True, measure)

    schema = StructType(rows.select(*kept).schema.fields
                        + _parse_datatype_string(", ".join(f"{n} {t}" for n, t, _ in added)).fields)
    return rows.select(*kept, packed(rows).alias("_g")).mapInArrow(run, schema)


def _nulled(values, kind: pa.DataType, kept: np.ndarray) -> pa.Array:
    """``values`` as an array of ``kind`` with nulls where not ``kept``."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return values.take(pa.array(np.arange(len(kept)), mask=~kept))


def pair_values(rows: DataFrame, pair_max_iter: int = 5000) -> DataFrame:
    """``rows`` with closeness and eigenvector as G22 compares them: an eigenvector that did not converge within
    ``pair_max_iter`` iterations counts as zeros."""
    sure = F.col("eigenvector_converged") & (F.col("eig_iterations") <= pair_max_iter)
    return rows.withColumn("eigenvector", F.transform("eigenvector", lambda x: F.when(sure, x).otherwise(0.0)))


def centrality_summaries(cent: DataFrame, keys: list[str], metrics=METRICS) -> DataFrame:
    """Mean, population std, max, min of each centrality per graph with at least 2 nodes
    (single-node graphs get no path metrics, so their summaries are 0 downstream)."""
    aggs = []
    for m in (m for m in ("closeness", "betweenness", "eigenvector") if m in metrics):
        aggs += [F.avg(m).alias(f"{m}_centrality_mean"), F.stddev_pop(m).alias(f"{m}_centrality_std"),
                 F.max(m).alias(f"{m}_centrality_max"), F.min(m).alias(f"{m}_centrality_min")]
    return (cent.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"), *aggs,
                                    F.min(F.col("converged").cast("int")).cast("boolean").alias("eigenvector_converged"))
            .filter("_v >= 2").drop("_v"))


def pairwise_path_cosines(cent: DataFrame, pair_max_iter: int = 5000) -> dict[str, DataFrame]:
    """Per-node closeness and eigenvector values for G22's cosines.

    The eigenvector vector of a graph counts only if it converged within ``pair_max_iter``
    iterations; otherwise the pair's eigenvector cosine is 0.
    """
    keys = ["problem_id", "sent_idx"]
    close = cent.select(*keys, "node", F.col("closeness").alias("value"))
    eig = cent.select(*keys, "node", F.when(F.col("converged") & (F.col("eig_iterations") <= pair_max_iter),
                                            F.col("eigenvector")).otherwise(F.lit(0.0)).alias("value"))
    return {"closeness": close, "eigenvector": eig}
