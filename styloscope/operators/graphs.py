"""Word adjacency networks (WAN) as edge/node tables and their metrics.

One table holds all graphs; the graph id is the composite key ``(problem_id, sent_idx)`` (or any
key list, e.g. ``(problem_id, window_start)`` for the sliding-window drift). Every metric is a
grouped aggregate or an equi-join on (graph, node) keys, so work spreads by graph *and* node and a
single huge sentence never lands in one task. Graph construction is in-row on the sentence's own
normalised token array.

Definitions (directed graph, self-loops removed, nodes kept):
average_degree 2E/V; density E/(V(V-1)) (0 if V<=1); degree centrality (in+out)/(V-1) (1 if V=1);
average_clustering over the undirected projection, 2T/(k(k-1)) per node, mean over all nodes;
assortativity = Pearson correlation over edges of out-degree(source) and in-degree(target), null
when undefined; degree_entropy = entropy of the total-degree histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from styloscope.functions import annotate as an
from styloscope.functions.numeric import safe_div
from styloscope.operators.tokens import normalize_sentences
from styloscope.session import store

KEY = ["problem_id", "sent_idx"]
POS_PREFIX = "POS_"


def _adjacent(arr: Column) -> Column:
    """Array of struct(src, dst) for consecutive elements (``arr`` must be a column reference)."""
    last = F.size(arr) - 2
    idx = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.struct(F.get(arr, i).alias("src"), F.get(arr, i + 1).alias("dst")))


def graph_inputs(norm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, tags, include_pos) with words = normalised tokens, tags = POS_<tag> per word."""
    if "norm_tags" in norm.columns:  # a caller's annotations
        tags = F.transform("norm_tags", lambda t: F.concat(F.lit(POS_PREFIX), t))
        return norm.select(*keys, "include_pos", F.col("norm_tokens").alias("words"), tags.alias("tags"))
    return norm.select(*keys, "include_pos", F.col("norm_tokens").alias("words")).select(
        *keys, "include_pos", "words",
        # words are casefolded already; passing an expression would re-evaluate it per reference
        F.transform("words", lambda w: F.concat(F.lit(POS_PREFIX), an.upos_lower(w))).alias("tags"))


def build_wan(graph_in: DataFrame, keys: list[str], stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes). Edges: keys, src, dst, weight, edge_type ('word' | 'pos_pos').

    Nodes: keys, node, node_type ('word' | 'POS'). A graph gets nodes only when it has at least two
    tokens (a single token adds no edge, hence no node); self-loops are dropped after the node table
    is derived, so their nodes stay.

    Edges and nodes come out of one explode and one ``groupBy`` (distinct nodes, pair counts). With
    ``stored`` that table is written to the shared folder and both are filters over it: metrics read edges and
    nodes many times, and without a stored table every one of these reads would tag the tokens again.
    """
    has_pairs = F.size("words") >= 2
    elem = "struct<kind:string,a:string,b:string,t:string>"

    def pair_elems(arr, etype):
        return F.transform(_adjacent(F.col(arr)), lambda p: F.struct(F.lit("e").alias("kind"), p["src"].alias("a"),
                                                                      p["dst"].alias("b"), F.lit(etype).alias("t")))

    def node_elems(arr, ntype):
        return F.transform(F.array_distinct(arr), lambda w: F.struct(F.lit("n").alias("kind"), w.alias("a"),
                                                                     F.lit(None).cast("string").alias("b"),
                                                                     F.lit(ntype).alias("t")))

    words = F.concat(pair_elems("words", "word"), node_elems("words", "word"))
    with_pos = F.concat(words, pair_elems("tags", "pos_pos"), node_elems("tags", "POS"))
    elems = F.when(~has_pairs, F.array().cast(f"array<{elem}>")).when(F.col("include_pos"), with_pos).otherwise(words)
    grouped = (graph_in.select(*keys, F.explode(elems).alias("x"))
               .select(*keys, "x.kind", "x.a", "x.b", "x.t")
               .groupBy(*keys, "kind", "a", "b", "t").agg(F.count(F.lit(1)).alias("c")))
    grouped = store(grouped, "wan") if stored else grouped
    edges = (grouped.filter((F.col("kind") == "e") & (F.col("a") != F.col("b")))
             .select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("weight"),
                     F.col("t").alias("edge_type")))
    nodes = grouped.filter(F.col("kind") == "n").select(*keys, F.col("a").alias("node"), F.col("t").alias("node_type"))
    return edges, nodes


def wan_for_sentences(spark: SparkSession, sentences: DataFrame, preset: str | None = None,
                      annotations: DataFrame | None = None):
    """Graphs of every sentence under its problem's preset (or a fixed preset), from the built-in annotator or a
    caller's ``annotations`` (the ``tokens`` table)."""
    norm = normalize_sentences(spark, sentences, preset, annotations)
    return build_wan(graph_inputs(norm, KEY), KEY, stored=True)


def node_degrees(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, node_type, in_deg, out_deg, deg) for every node, isolated ones included."""
    ends = edges.select(*keys, F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    u = (nodes.select(*keys, "node", "node_type", F.lit(0).alias("i"), F.lit(0).alias("o"))
         .unionByName(ends.select(*keys, "x.node", F.lit(None).cast("string").alias("node_type"), "x.i", "x.o")))
    return (u.groupBy(*keys, "node").agg(F.max("node_type").alias("node_type"), F.sum("i").alias("in_deg"),
                                         F.sum("o").alias("out_deg"))
            .withColumn("deg", F.col("in_deg") + F.col("out_deg")))


def _dc_stats(deg_col: str, v: Column, prefix: str) -> list[Column]:
    """Degree-centrality summaries from degree aggregates: deg/(V-1), or 1 when V == 1."""
    scale = lambda c: F.when(v == 1, F.lit(1.0)).otherwise(safe_div(c, v - 1))
    return [
        F.when(v == 0, 0.0).otherwise(scale(F.col(f"_{deg_col}_mean"))).alias(f"{prefix}_mean"),
        F.when(v <= 1, 0.0).otherwise(safe_div(F.col(f"_{deg_col}_std"), v - 1)).alias(f"{prefix}_std"),
        F.when(v == 0, 0.0).otherwise(scale(F.col(f"_{deg_col}_max"))).alias(f"{prefix}_max"),
        F.when(v == 0, 0.0).otherwise(scale(F.col(f"_{deg_col}_min"))).alias(f"{prefix}_min"),
    ]


def degree_metrics(deg: DataFrame, keys: list[str]) -> DataFrame:
    """G4, G5, G8, G9, G13, G15 (part), G17, G18 (degree), G19, G20 per graph.

    Graph rows exist for graphs with at least one node.
    """
    is_pos = F.col("node_type") == "POS"
    g = deg.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("V"), F.sum("out_deg").alias("E"),
        F.avg("deg").alias("_deg_mean"), F.stddev_pop("deg").alias("_deg_std"),
        F.max("deg").alias("_deg_max"), F.min("deg").alias("_deg_min"),
        F.avg("in_deg").alias("in_degree_mean"), F.stddev_pop("in_deg").alias("in_degree_std"),
        F.avg("out_deg").alias("out_degree_mean"), F.stddev_pop("out_deg").alias("out_degree_std"),
        F.sum((F.col("deg") >= 3).cast("int")).alias("_star"),
        F.sum(is_pos.cast("int")).alias("pos_node_count"),
        F.sum(F.when(is_pos, F.col("out_deg")).otherwise(0)).alias("_pos_E"),
        F.avg(F.when(is_pos, F.col("deg"))).alias("_pdeg_mean"),
        F.stddev_pop(F.when(is_pos, F.col("deg"))).alias("_pdeg_std"),
        F.lit(0).alias("_pdeg_max"), F.lit(0).alias("_pdeg_min"))
    v, e = F.col("V"), F.col("E")
    vp, ep = F.col("pos_node_count"), F.col("_pos_E")
    pos_dc = _dc_stats("pdeg", vp, "pos_centrality")
    return g.select(
        *keys, v.cast("long").alias("V"), e.cast("long").alias("E"),
        safe_div(2 * e, v).alias("average_degree"),
        F.when(v > 1, safe_div(e, v * (v - 1))).otherwise(0.0).alias("density"),
        *_dc_stats("deg", v, "degree_centrality"),
        "in_degree_mean", "in_degree_std", "out_degree_mean", "out_degree_std",
        safe_div(F.col("_star"), v).alias("star_ratio"),
        vp.cast("long").alias("pos_node_count"),
        safe_div(2 * ep, vp).alias("pos_avg_degree"),
        F.when(vp > 1, safe_div(ep, vp * (vp - 1))).otherwise(0.0).alias("pos_density"),
        pos_dc[0], pos_dc[1])


def degree_entropy(deg: DataFrame, keys: list[str]) -> DataFrame:
    """-sum p ln p over the histogram of total degrees."""
    h = deg.groupBy(*keys, "deg").agg(F.count(F.lit(1)).alias("c"))
    t = h.groupBy(*keys).agg(F.sum("c").alias("_n"), F.sum(F.col("c") * F.log("c")).alias("_s"))
    return t.select(*keys, (F.log("_n") - F.col("_s") / F.col("_n")).alias("degree_entropy"))


def pos_transition_entropy(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy of POS->POS transitions. Each distinct edge counts once (ln of the edge count);
    the weighted variant uses edge weights."""
    pe = edges.filter(F.col("src").contains(POS_PREFIX) & F.col("dst").contains(POS_PREFIX))
    t = pe.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.sum("weight").alias("_w"),
                              F.sum(F.col("weight") * F.log("weight")).alias("_s"))
    return t.select(*keys, F.log("_k").alias("pos_transition_entropy"),
                    (F.log("_w") - F.col("_s") / F.col("_w")).alias("pos_transition_entropy_weighted"))


def undirected_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """G6/G16 helpers: (per-node undirected degree k and triangle count t, per-graph triangle total).

    Edges are oriented from the lower to the higher (degree, name) endpoint, so every wedge is
    enumerated once at its lowest vertex and no vertex has more than sqrt(2E) oriented neighbours.
    """
    und = undirected_edges(edges, keys)
    ends = und.select(*keys, F.col("a").alias("node")).unionByName(und.select(*keys, F.col("b").alias("node")))
    k = ends.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("k"))
    ka = k.select(*keys, F.col("node").alias("a"), F.col("k").alias("ka"))
    kb = k.select(*keys, F.col("node").alias("b"), F.col("k").alias("kb"))
    ranked = und.join(ka, [*keys, "a"]).join(kb, [*keys, "b"])
    a_first = (F.col("ka") < F.col("kb")) | ((F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b")))
    oriented = ranked.select(*keys, F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("lo"),
                             F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("hi"))
    o1 = oriented.select(*keys, "lo", F.col("hi").alias("x"))
    o2 = oriented.select(*keys, "lo", F.col("hi").alias("y"))
    wedges = o1.join(o2, [*keys, "lo"]).filter(F.col("x") < F.col("y"))
    closing = und.select(*keys, F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    tri = wedges.join(closing, [*keys, "x", "y"], "left_semi")
    per_node = (tri.select(*keys, F.explode(F.array("lo", "x", "y")).alias("node"))
                .groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("t")))
    node_kt = k.join(per_node, [*keys, "node"], "left").fillna(0, ["t"])
    totals = tri.groupBy(*keys).agg(F.count(F.lit(1)).alias("triangle_count"))
    return node_kt, totals


def _round12(x):
    """Drop float summation-order noise (1e-16) so equal graphs compare equal; 12 decimals."""
    return F.floor(x * 1e12 + 0.5).cast("double") / 1e12


def clustering(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """G6 + G16: average_clustering (mean over *all* nodes) and triangle_count per graph."""
    node_kt, totals = triangles(edges, keys)
    c = F.when(F.col("k") >= 2, 2.0 * F.col("t") / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    csum = node_kt.groupBy(*keys).agg(F.sum(c).alias("_csum"))
    v = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    return (v.join(csum, keys, "left").join(totals, keys, "left")
            .select(*keys, F.when(F.col("_v") > 1, _round12(safe_div(F.coalesce(F.col("_csum"), F.lit(0.0)), F.col("_v"))))
                    .otherwise(0.0).alias("average_clustering"),
                    F.coalesce(F.col("triangle_count"), F.lit(0)).cast("long").alias("triangle_count")))


def assortativity(edges: DataFrame, deg: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson correlation of out-degree(source) and in-degree(target) over edges.

    Null when a variance is zero or the graph has no edges (undefined); 0 when V <= 1.
    """
    od = deg.select(*keys, F.col("node").alias("src"), F.col("out_deg").alias("x"))
    idg = deg.select(*keys, F.col("node").alias("dst"), F.col("in_deg").alias("y"))
    xy = edges.select(*keys, "src", "dst").join(od, [*keys, "src"]).join(idg, [*keys, "dst"])
    # exact integer moments, then one fixed sequence of float operations (order-independent result)
    s = xy.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("x").alias("_sx"), F.sum("y").alias("_sy"),
                              F.sum(F.col("x") * F.col("y")).alias("_sxy"), F.sum(F.col("x") * F.col("x")).alias("_sxx"),
                              F.sum(F.col("y") * F.col("y")).alias("_syy"))
    v = deg.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    n = F.col("_n")
    cov = (n * F.col("_sxy") - F.col("_sx") * F.col("_sy")).cast("double")
    var_x = (n * F.col("_sxx") - F.col("_sx") * F.col("_sx")).cast("double")
    var_y = (n * F.col("_syy") - F.col("_sy") * F.col("_sy")).cast("double")
    den = F.sqrt(var_x * var_y)
    r = F.when(F.col("_v") <= 1, F.lit(0.0)).when(F.coalesce(den, F.lit(0.0)) == 0, F.lit(None).cast("double")) \
        .otherwise(F.try_divide(cov, den))
    return v.join(s, keys, "left").select(*keys, r.alias("assortativity"))


def wan_metrics(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All count-based graph metrics per graph (graphs with at least one node)."""
    deg = node_degrees(edges, nodes, keys)
    m = degree_metrics(deg, keys)
    m = m.join(degree_entropy(deg, keys), keys, "left")
    m = m.join(clustering(edges, nodes, keys), keys, "left")
    m = m.join(assortativity(edges, deg, keys), keys, "left")
    m = m.join(pos_transition_entropy(edges, keys), keys, "left").fillna(
        0.0, ["pos_transition_entropy", "pos_transition_entropy_weighted"])
    return m


def _with_next_rows(df: DataFrame, item_cols: list[str], value: str | None = None) -> DataFrame:
    """Emit each row for its own sentence (s) and, as 'next', for the previous one (x)."""
    val = F.col(value) if value else F.lit(1.0)
    own = df.select("problem_id", F.col("sent_idx").alias("pair_idx"), *item_cols,
                    val.cast("double").alias("_s"), F.lit(None).cast("double").alias("_x"))
    nxt = df.select("problem_id", (F.col("sent_idx") - 1).alias("pair_idx"), *item_cols,
                    F.lit(None).cast("double").alias("_s"), val.cast("double").alias("_x"))
    return (own.unionByName(nxt).filter(F.col("pair_idx") >= 0)
            .groupBy("problem_id", "pair_idx", *item_cols).agg(F.sum("_s").alias("s"), F.sum("_x").alias("x")))


def wan_pairwise(edges: DataFrame, nodes: DataFrame, deg: DataFrame | None = None,
                 node_values: dict[str, DataFrame] | None = None) -> DataFrame:
    """G21/G22 for adjacent sentences whose graphs are both non-empty.

    edge_jaccard, node_jaccard, centrality_cosine (degree centrality over the union of nodes,
    absent = 0). ``node_values`` adds ``<name>_cosine`` for other per-node metrics
    (closeness, eigenvector) given as (problem_id, sent_idx, node, value).
    """
    deg = deg if deg is not None else node_degrees(edges, nodes, KEY)
    v = deg.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_v"))
    dc = deg.join(v, KEY).select(*KEY, "node", F.when(F.col("_v") == 1, F.lit(1.0))
                                 .otherwise(safe_div(F.col("deg"), F.col("_v") - 1)).alias("dc"))
    n_rows = _with_next_rows(dc, ["node"], "dc")
    s, x = F.col("s"), F.col("x")
    has_s, has_x = s.isNotNull(), x.isNotNull()
    na = n_rows.groupBy("problem_id", "pair_idx").agg(
        F.sum((has_s & has_x).cast("int")).alias("_ni"), F.sum(has_s.cast("int")).alias("_na"),
        F.sum(has_x.cast("int")).alias("_nb"),
        F.sum(F.coalesce(s, F.lit(0.0)) * F.coalesce(x, F.lit(0.0))).alias("_dot"),
        F.sum(F.coalesce(s, F.lit(0.0)) ** 2).alias("_ss"), F.sum(F.coalesce(x, F.lit(0.0)) ** 2).alias("_xx"))
    e_rows = _with_next_rows(edges.select(*KEY, "src", "dst"), ["src", "dst"])
    ea = e_rows.groupBy("problem_id", "pair_idx").agg(
        F.sum((F.col("s").isNotNull() & F.col("x").isNotNull()).cast("int")).alias("_ei"),
        F.sum(F.col("s").isNotNull().cast("int")).alias("_ea"), F.sum(F.col("x").isNotNull().cast("int")).alias("_eb"))
    both = na.filter((F.col("_na") > 0) & (F.col("_nb") > 0))
    out = both.join(ea, ["problem_id", "pair_idx"], "left").fillna(0, ["_ei", "_ea", "_eb"])
    cos = F.when((F.col("_ss") == 0) | (F.col("_xx") == 0), F.lit(0.0)).otherwise(
        F.col("_dot") / (F.sqrt("_ss") * F.sqrt("_xx")))
    res = out.select("problem_id", "pair_idx",
                     safe_div(F.col("_ei"), F.col("_ea") + F.col("_eb") - F.col("_ei")).alias("edge_jaccard"),
                     safe_div(F.col("_ni"), F.col("_na") + F.col("_nb") - F.col("_ni")).alias("node_jaccard"),
                     cos.alias("centrality_cosine"))
    for name, vals in (node_values or {}).items():
        r = _with_next_rows(vals.select(*KEY, "node", F.col("value")), ["node"], "value")
        sv, xv = F.coalesce(F.col("s"), F.lit(0.0)), F.coalesce(F.col("x"), F.lit(0.0))
        a = r.groupBy("problem_id", "pair_idx").agg(F.sum(sv * xv).alias("_d"), F.sum(sv * sv).alias("_a"),
                                                    F.sum(xv * xv).alias("_b"))
        c = a.select("problem_id", "pair_idx", F.when((F.col("_a") == 0) | (F.col("_b") == 0), F.lit(0.0))
                     .otherwise(F.col("_d") / (F.sqrt("_a") * F.sqrt("_b"))).alias(f"{name}_cosine"))
        res = res.join(c, ["problem_id", "pair_idx"], "left").fillna(0.0, [f"{name}_cosine"])
    return res
