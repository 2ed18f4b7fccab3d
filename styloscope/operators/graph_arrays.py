"""Many graphs at once as flat numpy arrays: the kernel side of ``adjacency`` and ``paths``.

A ``Graphs`` holds the graphs of some rows end to end: node places get the graph's offset added, so one numpy call works on
all graphs of a slice of an Arrow batch instead of one call, or one interpreted expression, for each graph or element.
Slices are cut by the number of nodes and edges, so what a step holds at a time does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.functions.arrays import MASK, SHIFT, let

#: About so many nodes and edges are worked on at a time.
SLICE_CELLS = 1 << 20


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def slices(costs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive items whose costs sum to ``most`` at most, or single ones that cost more."""
    ends, first, spent = np.cumsum(costs), 0, 0
    while first < len(costs):
        last = max(first + 1, int(np.searchsorted(ends, spent + most, side="right")))
        yield first, last
        first, spent = last, ends[last - 1]


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal elements begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


class Graphs:
    """Graphs end to end. ``n`` nodes and ``e`` edges a graph; ``off`` and ``e_off`` where they begin (and the end);
    ``gid`` the graph of each node; ``src`` and ``dst`` the edges' ends, ordered by (graph, src, dst); ``words``: how many
    nodes of each graph, the first ones, are words; ``weights``: how often each edge occurs."""

    def __init__(self, n: np.ndarray, e: np.ndarray, src: np.ndarray, dst: np.ndarray,
                 words: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.n, self.e, self.size = n.astype(np.int64), e.astype(np.int64), len(n)
        self.off, self.e_off = (np.concatenate(([0], np.cumsum(x))) for x in (self.n, self.e))
        self.gid = np.repeat(np.arange(self.size), self.n)
        shift = np.repeat(self.off[:-1], self.e)
        self.src, self.dst = src + shift, dst + shift
        self.words, self.weights = words, weights

    def sums(self, per_node: np.ndarray) -> np.ndarray:
        """Sums over each graph's nodes (every graph has some)."""
        return np.add.reduceat(per_node, self.off[:-1])

    def degrees(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = int(self.off[-1])
        return np.bincount(self.src, minlength=nodes), np.bincount(self.dst, minlength=nodes)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and the elements of a list column."""
    return lengths(column), column.flatten().to_numpy(zero_copy_only=False)


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(strings: pa.Array) -> tuple[np.ndarray, int]:
    """For each string its place among the distinct ones in the order of their bytes, and the number of these."""
    found = strings.dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy(zero_copy_only=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[found.indices.to_numpy(zero_copy_only=False)], len(order)


def _steps(ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    on = (of[1:] == of[:-1]) & (ids[1:] != ids[:-1])
    return ids[:-1][on], ids[1:][on]


def of_words(words: pa.Array, tags: pa.Array) -> tuple[Graphs, np.ndarray, int]:
    """The graphs of texts from their words and tags (``adjacency.graph_of``), with the code of each node's name, ordered
    as the names are, and the number of codes."""
    size, of = len(words), [np.repeat(np.arange(len(words)), lengths(x)) for x in (words, tags)]
    (w, n_words), (t, n_tags) = coded(words.flatten()), coded(tags.flatten())
    names = max(1, n_words + n_tags)
    nodes, ids = np.unique(np.concatenate((of[0] * names + w, of[1] * names + n_words + t)), return_inverse=True)
    gid, code = nodes // names, nodes % names
    ends = [np.concatenate(x) for x in zip(_steps(ids[:len(w)], of[0]), _steps(ids[len(w):], of[1]))]
    edges, weights = np.unique(ends[0] * len(nodes) + ends[1], return_counts=True)
    src, dst = edges // max(1, len(nodes)), edges % max(1, len(nodes))
    n, e = np.bincount(gid, minlength=size), np.bincount(gid[src], minlength=size)
    first = np.repeat(np.cumsum(n) - n, e)
    return Graphs(n, e, src - first, dst - first, np.bincount(gid[code < n_words], minlength=size), weights), code, names


# --- rows of a DataFrame ----------------------------------------------------------------------

#: The columns that hold a row's graph: the graph itself, or the words and tags that it is of (``graphs.graph_inputs``).
GRAPH, TEXT = ("graph",), ("words", "tags", "include_pos")


def held(rows: DataFrame) -> tuple[str, ...]:
    """The columns that hold the graphs of ``rows``."""
    return GRAPH if "graph" in rows.columns else TEXT


def others(rows: DataFrame) -> list[str]:
    """The columns besides the graph's."""
    return [c for c in rows.columns if c not in held(rows)]


def packed(rows: DataFrame, suffix: str = "") -> Column:
    """What the kernels read of a row's graph, in one struct."""
    if f"graph{suffix}" not in rows.columns:
        words, tags, with_tags = (F.col(f"{c}{suffix}") for c in TEXT)
        kept = F.when(with_tags, tags).otherwise(F.array().cast("array<string>"))
        return F.struct(words.alias("words"), kept.alias("tags"))
    # one expression of the graph: several would each build it again where it is not stored
    return let(F.col(f"graph{suffix}"), lambda g: F.struct(
        g["n_tokens"].alias("t"), g["nodes"].alias("nodes"), g["edges"].alias("e"), g["weights"].alias("w")))


def _unpacked(column: pa.StructArray) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray]:
    """The fields, the number of tokens and the nodes and edges (or words and tags) of each row."""
    fields = dict(zip((f.name for f in column.type), column.flatten()))
    if "words" in fields:
        tokens = lengths(fields["words"])
        return fields, tokens, tokens + lengths(fields["tags"])
    tokens = fields["t"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return fields, tokens, lengths(fields["nodes"]) + lengths(fields["e"])


def _graphs(fields: dict[str, pa.Array], rows: np.ndarray) -> tuple[Graphs, np.ndarray, int]:
    """``of_words`` for some rows of ``_unpacked`` fields."""
    part = {c: x.take(pa.array(rows)) for c, x in fields.items()}
    if "words" in part:
        return of_words(part["words"], part["tags"])
    n, names = lengths(part["nodes"]), part["nodes"].flatten()
    (e, edges), (code, size) = lists(part["e"]), coded(names)
    word = pc.starts_with(names, "0").to_numpy(zero_copy_only=False)
    words = np.bincount(np.repeat(np.arange(len(n)), n)[word], minlength=len(n))
    return Graphs(n, e, edges >> SHIFT, edges & MASK, words, lists(part["w"])[1]), code, size


def made(values: dict[str, object], columns: dict[str, pa.DataType]) -> dict[str, pa.Array]:
    return {c: values[c] if isinstance(values[c], pa.Array) else pa.array(values[c], t) for c, t in columns.items()}


def measured(batch: pa.RecordBatch, columns: dict[str, pa.DataType], every_row: bool,
             measure: Callable[[Graphs], dict[str, object]]) -> Iterator[pa.RecordBatch]:
    """``batch`` without its last column, a ``packed`` one, and with ``measure``'s values of each row's graph instead.

    Graphs of fewer than two tokens are not measured: nulls with ``every_row``, else no row.
    """
    rest = batch.select(range(batch.num_columns - 1))
    fields, tokens, costs = _unpacked(batch.column(batch.num_columns - 1))
    for first, last in slices(costs, SLICE_CELLS):
        rows = np.flatnonzero(tokens[first:last] >= 2) + first
        found = {c: pa.nulls(0, t) for c, t in columns.items()}
        if len(rows):
            found = made(measure(_graphs(fields, rows)[0]), columns)
        if every_row:
            at = np.full(last - first, -1)
            at[rows - first] = np.arange(len(rows))
            found = {c: x.take(pa.array(at, mask=at < 0)) for c, x in found.items()}
            kept = rest.slice(first, last - first)
        else:
            kept = rest.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*kept.columns, *found.values()], names=[*kept.schema.names, *found])


def compared(batch: pa.RecordBatch, keys: int, values: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The first ``keys`` columns and G21, G22 of the rows whose two graphs have two tokens each.

    The columns after the keys are two ``packed`` ones and, for each of ``values``, two arrays with a number for each node.
    """
    (a, t_a, cost_a), (b, t_b, cost_b) = (_unpacked(batch.column(keys + k)) for k in (0, 1))
    for first, last in slices(cost_a + cost_b, SLICE_CELLS):
        rows = np.flatnonzero((t_a[first:last] >= 2) & (t_b[first:last] >= 2)) + first
        kept = batch.select(range(keys)).take(pa.array(rows))
        names = ["edge_jaccard", "node_jaccard", "centrality_cosine", *[f"{v}_cosine" for v in values]]
        found = dict.fromkeys(names, np.zeros(0))
        if len(rows):
            both = {c: pa.concat_arrays([a[c].take(pa.array(rows)), b[c].take(pa.array(rows))]) for c in a}
            g, code, size = _graphs(both, np.arange(2 * len(rows)))
            arrays = [[batch.column(keys + 2 + 2 * k + side).take(pa.array(rows)) for side in (0, 1)] for k in range(len(values))]
            found = dict(zip(names, _compared(g, code, size, [pa.concat_arrays(x) for x in arrays])))
        yield pa.RecordBatch.from_arrays([*kept.columns, *made(found, dict.fromkeys(names, pa.float64())).values()],
                                         names=[*kept.schema.names, *names])


def _compared(g: Graphs, code: np.ndarray, size: int, values: list[pa.Array]) -> list[np.ndarray]:
    """The first half of ``g``'s graphs against the second half."""
    pairs = g.size // 2
    left, nodes = int(g.off[pairs]), len(g.gid)
    named = (g.gid % pairs) * size + code  # ascending in each half
    at = np.minimum(np.searchsorted(named[left:], named[:left]), nodes - left - 1) + left
    same = np.flatnonzero(named[at] == named[:left])
    match = np.full(left, -1)
    match[same] = at[same]
    pair = g.gid[same]
    edges = int(g.e_off[pairs])
    s, d = match[g.src[:edges]], match[g.dst[:edges]]
    both = np.flatnonzero((s >= 0) & (d >= 0))
    there = g.src[edges:] * nodes + g.dst[edges:]
    sought = s[both] * nodes + d[both]
    shared = both[:0]
    if len(there):
        shared = both[there[np.minimum(np.searchsorted(there, sought), len(there) - 1)] == sought]
    shared, common = (np.bincount(x, minlength=pairs) for x in (g.gid[g.src[shared]], pair))

    def cosine(x: np.ndarray) -> np.ndarray:
        product, squares = np.bincount(pair, x[same] * x[match[same]], pairs), g.sums(x * x)
        return _ratio(product, np.sqrt(squares[:pairs]) * np.sqrt(squares[pairs:]))

    out, into = g.degrees()
    found = [_ratio(shared, g.e[:pairs] + g.e[pairs:] - shared), _ratio(common, g.n[:pairs] + g.n[pairs:] - common),
             cosine(np.where(g.n == 1, 1, 0)[g.gid] + (out + into) * (g.n != 1)[g.gid])]
    for v in values:  # a graph without values, which has one node, counts as zeros
        x, (n, given) = np.zeros(nodes), lists(v)
        x[np.repeat(n > 0, g.n)] = given
        found.append(cosine(x))
    return found


# --- metrics of the degrees and edges ---------------------------------------------------------


def _ratio(a: np.ndarray, b) -> np.ndarray:
    """a / b, 0 where b is 0."""
    b = np.broadcast_to(np.asarray(b, float), np.shape(a))
    return np.divide(a, b, out=np.zeros(np.shape(a)), where=b != 0)


def _spread(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Population standard deviation from count, sum and sum of squares (integers)."""
    return _ratio(np.sqrt((n * q - s * s).astype(float)), n)


def _summaries(prefix: str, n, s, q, most, least) -> dict[str, np.ndarray]:
    """Degree centrality (degree / (n - 1), or 1 for one node): mean, standard deviation, max, min."""
    scaled = lambda x: np.where(n == 1, 1.0, np.where(n == 0, 0.0, _ratio(x, n - 1)))
    return {f"{prefix}_mean": scaled(_ratio(s, n)), f"{prefix}_std": np.where(n <= 1, 0.0, _ratio(_spread(n, s, q), n - 1)),
            f"{prefix}_max": scaled(most), f"{prefix}_min": scaled(least)}


def entropies(groups: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Natural-log entropy of the weights of each group; 0 for none."""
    total = np.bincount(groups, weights, size)
    by_weight = np.bincount(groups, weights * np.log(weights), size)
    return np.where(total > 0, np.log(np.where(total > 0, total, 1)) - _ratio(by_weight, total), 0.0)


def degree_values(g: Graphs, out: np.ndarray, into: np.ndarray) -> dict[str, np.ndarray]:
    """G4, G5, G8, G9, G13, G15, G17, G18 (degree), G19, G20 from the degrees out of and into each node."""
    v, e, deg, words = g.n, g.e, out + into, g.words
    tag = np.arange(len(deg)) - g.off[g.gid] >= words[g.gid]
    s, q, starts = g.sums(deg), g.sums(deg * deg), g.off[:-1]
    tags, pos_s, pos_q = v - words, g.sums(deg * tag), g.sums(deg * deg * tag)
    counted = np.sort(g.gid * (int(deg.max()) + 1) + deg)
    at = heads(counted)
    counts = np.diff(np.append(at, len(counted))).astype(float)
    by_count = np.bincount(counted[at] // (int(deg.max()) + 1), counts * np.log(counts), g.size)
    pos = _summaries("pos_centrality", tags, pos_s, pos_q, 0 * tags, 0 * tags)
    return {
        "V": v, "E": e, "average_degree": _ratio(2 * e, v),
        "density": np.where(v > 1, _ratio(e, v.astype(float) * (v - 1)), 0.0),
        **_summaries("degree_centrality", v, s, q, np.maximum.reduceat(deg, starts), np.minimum.reduceat(deg, starts)),
        "in_degree_mean": _ratio(e, v), "in_degree_std": _spread(v, g.sums(into), g.sums(into * into)),
        "out_degree_mean": _ratio(e, v), "out_degree_std": _spread(v, g.sums(out), g.sums(out * out)),
        "star_ratio": _ratio(g.sums((deg >= 3).astype(np.int64)), v), "pos_node_count": tags,
        "pos_avg_degree": _ratio(pos_s, tags),
        "pos_density": np.where(tags > 1, _ratio(pos_s / 2, tags.astype(float) * (tags - 1)), 0.0),
        "pos_centrality_mean": pos["pos_centrality_mean"], "pos_centrality_std": pos["pos_centrality_std"],
        "degree_entropy": np.log(v) - by_count / v}


def transition_values(g: Graphs) -> dict[str, np.ndarray]:
    """Entropy of the tag-to-tag edges, each once, and by weight; 0 without such edges."""
    of = g.gid[g.src]
    tag = g.src - g.off[of] >= g.words[of]
    return {"pos_transition_entropy": entropies(of[tag], np.ones(tag.sum()), g.size),
            "pos_transition_entropy_weighted": entropies(of[tag], g.weights[tag].astype(float), g.size)}


def assortativity_values(g: Graphs, out: np.ndarray, into: np.ndarray) -> dict[str, pa.Array]:
    """Pearson correlation over edges of the source's out-degree and the target's in-degree; null if undefined."""
    n, x, y = g.e, g.sums(out * out), g.sums(into * into)
    xx, yy = g.sums(out * out * out), g.sums(into * into * into)
    ends = np.concatenate(([0], np.cumsum(out[g.src] * into[g.dst])))
    xy = ends[g.e_off[1:]] - ends[g.e_off[:-1]]
    spread = np.sqrt((n * xx - x * x).astype(float) * (n * yy - y * y).astype(float))
    value = np.where(g.n <= 1, 0.0, _ratio((n * xy - x * y).astype(float), spread))
    return {"assortativity": pa.array(value, pa.float64(), mask=(g.n > 1) & (spread == 0))}


def clustering_values(g: Graphs) -> dict[str, np.ndarray]:
    """Average clustering over all nodes and the number of triangles of the undirected graph.

    Nodes are numbered by (graph, degree, place) and each edge goes from the lower to the higher number, so a triangle is
    found once, as a step a -> b -> c whose ends are an edge a -> c, and no node has more steps on than the root of twice
    its graph's edges. A triangle adds 2 / (k (k - 1)) for each of its nodes to the sum of the nodes' coefficients.
    """
    nodes = len(g.gid)
    both = np.unique(np.minimum(g.src, g.dst) * nodes + np.maximum(g.src, g.dst))
    a, b = both // max(1, nodes), both % max(1, nodes)
    k = np.bincount(a, minlength=nodes) + np.bincount(b, minlength=nodes)
    order = np.lexsort((k, g.gid))
    number = np.empty(nodes, np.int64)
    number[order] = np.arange(nodes)
    ranked = k[order].astype(float)
    share = np.where(ranked >= 2, _ratio(np.full(nodes, 2.0), ranked * (ranked - 1)), 0.0)
    low, high = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
    edges = np.sort(low * nodes + high)
    low, high = edges // max(1, nodes), edges % max(1, nodes)
    onward = np.bincount(low, minlength=nodes)
    start = np.concatenate(([0], np.cumsum(onward)))
    count, total = np.zeros(g.size), np.zeros(g.size)
    for first, last in slices(onward[high], SLICE_CELLS):
        steps = onward[high[first:last]]
        x, y, z = np.repeat(low[first:last], steps), np.repeat(high[first:last], steps), high[ranges(start[high[first:last]], steps)]
        at = np.searchsorted(edges, x * nodes + z)
        closed = edges[np.minimum(at, len(edges) - 1)] == x * nodes + z
        of = g.gid[x[closed]]  # graphs keep their order under the numbering
        count += np.bincount(of, minlength=g.size)
        total += np.bincount(of, share[x[closed]] + share[y[closed]] + share[z[closed]], g.size)
    return {"average_clustering": np.where(g.n > 1, np.floor(total / g.n * 1e12 + 0.5) / 1e12, 0.0),
            "triangle_count": count.astype(np.int64)}
