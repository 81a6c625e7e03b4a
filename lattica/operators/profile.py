"""Structural ratios and index families, each family from one or two aggregations over tables that exist already.

Every function returns (name, value). Components, triangles, coreness and distances are computed once for
a family and written; what is left are aggregations over vertices, edges or degree classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.degree import degree_distribution
from lattica.operators.iterate import connected_components
from lattica.operators.lists import neighbour_lists, over_edges
from lattica.operators.triangles import at_vertices, clustering, edge_support


def named(row: DataFrame, made: dict[str, str]) -> DataFrame:
    """A row, as (name, value) for each expression of ``made``; what is null counts as 0."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.expr(x).cast("double"), F.lit(0.0)).alias("value")) for n, x in made.items()])
    return row.select(F.explode(pairs).alias("p")).select("p.name", "p.value")


def beside(*rows: DataFrame) -> DataFrame:
    """Frames of one row each, side by side."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(F.broadcast(r.withColumn("_one", F.lit(1))), "_one")  # one row
    return out.drop("_one")


def log2_factorial(x: str) -> str:
    """SQL: log2 of x!, by Stirling's series on x + 8 less the factors added."""
    y, product = f"({x} + 8.0D)", " * ".join(f"({x} + {i}.0D)" for i in range(1, 9))
    return f"(({y} * ln({y}) - {y} + 0.5D * ln(2 * pi() * {y}) + 1 / (12 * {y}) - 1 / (360 * power({y}, 3)) + 1 / (1260 * power({y}, 5)) - 1 / (1680 * power({y}, 7)) - ln({product})) / ln(2.0D))"


def component_sizes(g: Graph) -> DataFrame:
    """One row: c components, the sizes of the largest and the second (0 if there is one)."""
    sizes = connected_components(g).groupBy("component").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("times"))
    top = Window.partitionBy(F.lit(0)).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each size
    sizes = sizes.withColumn("before", F.coalesce(F.sum("times").over(top), F.lit(0)))
    second = F.max(F.expr("case when before <= 1 and before + times > 1 then k end"))
    return sizes.agg(F.sum("times").alias("c"), F.max("k").alias("big"), F.coalesce(second, F.lit(0)).alias("second"))


def edge_counts(g: Graph) -> DataFrame:
    """One row: m edges, loops, distinct pairs."""
    pairs = g.edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    return pairs.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"), F.coalesce(F.sum(F.expr("case when src = dst then k end")), F.lit(0)).alias("loops"), F.count("*").alias("pairs"))


STRUCTURE = {
    "component_ratio": "c / n", "largest_component_fraction": "big / n", "giant_component_gap": "(big - second) / n", "vertex_connectivity_ratio": "bottom / (n - 1)", "vertex_conn_ratio": "case when c = 1 then bottom / (n - 1) end",
    "edge_conn_ratio": "case when c = 1 then bottom / (n - 1) end", "min_degree_connectivity_ratio": "case when c = 1 then bottom / (s / n) end", "self_loop_ratio": "loops / m", "multi_edge_ratio": "(m - pairs) / m", "circuit_rank_ratio": "(m - n + c) / m",
    "meshedness_coefficient": "case when c = 1 and n >= 3 then (m - n + 1) / (2 * n - 5) end", "edge_surplus_ratio": "case when n >= 3 and n * (n - 1) / 2 - n + c <> 0 then (m - n + c) / (n * (n - 1) / 2 - n + c) end",
    "edge_connectivity_ratio": "2 * m / (n * (n - 1))", "degree_density": "(q / s - 1) / (n - 1)", "cyclomatic_density": "(m - n + c) / n", "flow_hierarchy_ratio": "(n - c) / m", "degree_structural_info": "log_n - log_k",
    "degree_centralization": "(n * top - s) / ((n - 1) * (n - 2))", "centrality_entropy": "walk", "isolated_vertex_ratio": "zeros / n", "degree_median_ad": "mad", "regularity": "case when top = bottom then top end", "count_loops": "loops",
    "satisfies_dirac": "case when n >= 3 and 2 * bottom >= n then 1 else 0 end", "centralization_degree": "n * top - s", "max_flow_efficiency": "case when bottom > 0 then least_pairs / (n * (n - 1) / 2) / bottom end",
    "bandwidth_lower_bound_by_degree": "ceil(top / 2)",
}


def structure_ratios(g: Graph) -> DataFrame:
    """Ratios of counts: vertices, edges, loops, copies, components and degree classes. For undirected graphs."""
    classes = degree_distribution(g).select(F.col("degree").cast("double").alias("d"), F.col("n_vertices").cast("double").alias("k"))
    whole, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a row for each degree
    t = classes.withColumn("n", F.sum("k").over(whole)).withColumn("s", F.sum(F.expr("k * d")).over(whole)).withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0.0)))
    at = lambda rank: f"max(case when before <= {rank} and {rank} < before + k then d end)"
    median = F.expr(f"({at('floor((n - 1) / 2)')} + {at('ceil((n - 1) / 2)')}) / 2")
    one = t.agg(
        F.max("n").alias("n"), F.max("s").alias("s"), F.max("d").alias("top"), F.min("d").alias("bottom"), F.sum(F.expr("k * d * d")).alias("q"), F.sum(F.expr("case when d = 0 then k else 0 end")).alias("zeros"),
        F.sum(F.expr(log2_factorial("k"))).alias("log_k"), F.expr(f"max({log2_factorial('n')})").alias("log_n"), F.sum(F.expr("case when d > 0 then -k * (d / s) * ln(d / s) else 0 end")).alias("walk"),
        F.sum(F.expr("d * (k * (k - 1) / 2 + k * (n - before - k))")).alias("least_pairs"), median.alias("median"),
    )
    # the median of the distances from the median, from the classes again
    gaps = beside(one.select("median", F.col("n").alias("total")), classes.agg(F.collect_list(F.struct("d", "k")).alias("cs"))).select("median", "total", F.explode("cs").alias("x"))
    gaps = gaps.groupBy(F.abs(F.col("x.d") - F.col("median")).alias("d"), F.col("total").alias("n")).agg(F.sum("x.k").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0.0)))
    mad = gaps.agg(F.expr(f"({at('floor((n - 1) / 2)')} + {at('ceil((n - 1) / 2)')}) / 2").alias("mad"))
    return named(beside(one, mad, component_sizes(g), edge_counts(g)), STRUCTURE)


NEIGHBOURS = {
    "degree_neighbor_max_sum": "mx", "degree_neighbor_min_sum": "mn", "degree_neighbor_range_sum": "mx - mn", "degree_neighbor_variance_sum": "var", "avg_neighbor_degree_ratio": "ratio / touched", "neighbor_degree_disparity": "ratio / touched",
    "neighbor_connectivity_ratio": "low_high / touched", "degree_neighbor_correlation": "corr", "avg_neighbor_connectivity": "mean / n", "first_neighborhood_zagreb": "s2", "neighborhood_forgotten_index": "s3", "second_neighborhood_zagreb": "ss",
    "first_ve_degree_zagreb_alpha": "ve2", "first_ve_degree_zagreb_beta": "ve_sum", "second_ve_degree_zagreb": "ve_product",
}


def _around(v: np.ndarray, x: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Sum, sum of squares, greatest and least degree of the neighbours that a task knows of each vertex."""
    (d,) = x
    s, q = (np.bincount(a, w[b], len(v)) + np.bincount(b, w[a], len(v)) for w in (d.astype(float), d.astype(float) ** 2))
    most, least = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for one, other in ((a, b), (b, a)):
        np.maximum.at(most, one, d[other])
        np.minimum.at(least, one, d[other])
    seen = np.flatnonzero(most)
    return pa.table({"v": v[seen], "s": s[seen].astype(np.int64), "q": q[seen], "mx": most[seen], "mn": least[seen]})


def _products(v: np.ndarray, x: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Sums over edges of the products of each value at the ends."""
    s, ve = (c.astype(float) for c in x)
    return pa.table({"ss": [float(np.sum(s[a] * s[b]))], "ve_product": [float(np.sum(ve[a] * ve[b]))]})


def neighbor_degree_measures(g: Graph) -> DataFrame:
    """Measures of the degrees around each vertex, and of those sums at the ends of edges; for simple undirected graphs.

    ve-degree: the edges incident to a vertex or its neighbours, counted as the sum of the neighbours' degrees less the triangles at it.
    Degrees and sums reach the edges by blocks of vertices; an edge that is there more than once counts once.
    """
    lists = neighbour_lists(g)
    at = store(at_vertices(lists))
    around = over_edges(lists, at.select("v", "degree"), _around, "v long, s long, q double, mx long, mn long").groupBy("v").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("mx").cast("double").alias("mx"), F.min("mn").cast("double").alias("mn"))
    v = store(at.join(around, "v").select("v", F.col("degree").cast("double").alias("d"), "s", "mx", "mn", F.expr("s - triangles").alias("ve"), F.expr(
        # exact: decimals of up to 38 digits
        "cast(cast(degree as decimal(19, 0)) * cast(q as decimal(19, 0)) - cast(s as decimal(19, 0)) * cast(s as decimal(19, 0)) as double) / (cast(degree as double) * degree)").alias("var")))
    r = v.select("d", "mx", "mn", "var", F.col("s").cast("double").alias("s"), F.col("ve").cast("double").alias("ve"), F.expr("s / d").alias("mean"))
    a = r.agg(
        F.count("*").alias("touched"), F.sum("mx").alias("mx"), F.sum("mn").alias("mn"), F.sum("var").alias("var"), F.sum(F.expr("mean / d")).alias("ratio"), F.sum(F.expr("mn / mx")).alias("low_high"),
        F.corr("d", "mean").alias("corr"), F.sum("mean").alias("mean"), F.sum(F.expr("s * s")).alias("s2"), F.sum(F.expr("s * s * s")).alias("s3"), F.sum(F.expr("ve * ve")).alias("ve2"), F.sum(F.expr("d * ve")).alias("ve_sum"),
    )
    b = over_edges(lists, v.select("v", "s", "ve"), _products, "ss double, ve_product double").agg(F.sum("ss").alias("ss"), F.sum("ve_product").alias("ve_product"))
    return named(beside(a, b, g.vertices.agg(F.count("*").alias("n"))), NEIGHBOURS)


ADJACENT_EDGES = {"second_reformulated_zagreb": "product", "second_ev_degree_zagreb": "product", "ev_degree_randic": "randic"}


def adjacent_edge_measures(g: Graph) -> DataFrame:
    """Sums over pairs of edges that share an end, of e = du + dv - 2; for simple undirected graphs.

    The pairs at a vertex sum to half of (sum squared less sum of squares), so no pair is listed.
    """
    e = g.edge_degrees.where("src != dst").withColumn("e", F.expr("du + dv - 2"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("v"), "e").withColumn("r", F.expr("case when e > 0 then 1 / sqrt(e) end"))
    at = ends.groupBy("v").agg(F.expr("(sum(e) * sum(e) - sum(e * e)) / 2").alias("product"), F.expr("(sum(r) * sum(r) - sum(r * r)) / 2").alias("randic"))
    return named(at.agg(F.sum("product").alias("product"), F.sum("randic").alias("randic")), ADJACENT_EDGES)


OVERLAP = {
    "edge_common_neighbor_sum": "common", "edge_jaccard_sum": "jaccard", "edge_overlap_sum": "overlap", "edge_adamic_adar_sum": "aa", "mean_forman_ricci": "forman / m", "min_forman_ricci": "least", "max_forman_ricci": "most",
    "triangle_participation": "inside / n", "triangle_density": "6 * t / (n * (n - 1) * (n - 2))", "pendant_edge_ratio": "pendant / m", "average_sombor_index": "sombor / m",
}


def forman_ricci_curvature(g: Graph) -> DataFrame:
    """(a, b, curvature): 4 - du - dv + 3 triangles, for the edges of a simple undirected graph."""
    d = g.degrees().select("v", F.col("d").cast("double").alias("d"))
    s = edge_support(g).join(d.select(F.col("v").alias("a"), F.col("d").alias("du")), "a").join(d.select(F.col("v").alias("b"), F.col("d").alias("dv")), "b")
    return s.select("a", "b", real(F.expr("4 - du - dv + 3 * support")).alias("curvature"), "support", "du", "dv")


def edge_overlap_measures(g: Graph) -> DataFrame:
    """What neighbourhoods at the ends of edges share, and what triangles say of edges; for simple undirected graphs."""
    e = store(forman_ricci_curvature(g))
    a = e.agg(
        F.count("*").alias("m"), F.sum("support").alias("common"), F.sum(F.expr("support / nullif(du + dv - 2 - support, 0)")).alias("jaccard"), F.sum(F.expr("support / nullif(least(du, dv) - 1, 0)")).alias("overlap"), F.sum("curvature").alias("forman"),
        F.min("curvature").alias("least"), F.max("curvature").alias("most"), F.count_if(F.expr("least(du, dv) = 1")).alias("pendant"), F.sum(F.expr("sqrt(du * du + dv * dv)")).alias("sombor"),
    )
    at = clustering(g).select("v", "degree", "triangles")
    b = at.agg(F.sum(F.expr("case when degree > 1 then triangles / ln(degree) end")).alias("aa"), F.count_if(F.col("triangles") > 0).alias("inside"), F.count("*").cast("double").alias("n"), (F.sum("triangles") / 3).alias("t"))
    return named(beside(a, b), OVERLAP)


CLUSTERING = {
    "clustering_variance": "case when k >= 2 then var end", "clustering_bimodality": "case when k >= 4 and m2 > 1e-30 then (power(m3 / power(m2, 1.5D), 2) + 1) / (m4 / (m2 * m2)) end", "clustering_degree_correlation": "corr",
    "transitivity_gap": "closed / triples - mean", "closed_triplet_ratio": "closed / triples", "local_density_ratio": "mean", "odd_cycle_density": "closed / triples", "clustering_entropy": "case when bins > 1 then (ln(k) - klnk / k) / ln(bins) end",
}


def clustering_profile(g: Graph) -> DataFrame:
    """How local clustering is spread over the vertices of degree 2 or more; for simple undirected graphs. Entropy: of ten equal bins."""
    c = store(clustering(g).where("degree >= 2"))
    mean = c.agg(F.avg("transitivity").alias("mean"), F.count("*").cast("double").alias("k"))
    t = c.withColumn("_j", F.lit(1)).join(F.broadcast(mean.withColumn("_j", F.lit(1))), "_j")  # one row
    moments = t.agg(
        F.var_pop("transitivity").alias("var"), F.avg(F.expr("power(transitivity - mean, 2)")).alias("m2"), F.avg(F.expr("power(transitivity - mean, 3)")).alias("m3"), F.avg(F.expr("power(transitivity - mean, 4)")).alias("m4"),
        F.corr(F.col("degree").cast("double"), F.col("transitivity")).alias("corr"), F.sum("triangles").alias("closed"), F.sum(F.expr("degree * (degree - 1) / 2")).alias("triples"),
    )
    bins = c.groupBy(F.least(F.floor(F.col("transitivity") * 10), F.lit(9)).alias("bin")).agg(F.count("*").cast("double").alias("x"))
    return named(beside(moments, mean, bins.agg(F.count("*").alias("bins"), F.sum(F.expr("x * ln(x)")).alias("klnk"))), CLUSTERING)


CORES = {
    "degeneracy": "top", "core_ratio": "inside / n", "core_density": "case when inside > 1 then 2 * held / (inside * (inside - 1)) end", "periphery_fraction": "ones / n", "core_periphery_gradient": "case when n > 1 and top > 0 then (top - 1) / (n - 1) end",
    "core_persistence": "mean / top", "shell_diversity": "case when shells > 1 then (ln(n) - klnk / n) / ln(shells) end", "degeneracy_gap": "(top - mean) / top",
}


def core_profile(g: Graph, cores: DataFrame) -> DataFrame:
    """Measures of a coreness table (v, coreness) of ``g``."""
    shells = cores.groupBy(F.col("coreness").cast("double").alias("c")).agg(F.count("*").cast("double").alias("k"))
    a = shells.agg(F.max("c").alias("top"), F.max_by("k", "c").alias("inside"), F.sum("k").alias("n"), F.sum(F.expr("case when c = 1 then k else 0 end")).alias("ones"), F.expr("sum(c * k) / sum(k)").alias("mean"), F.count("*").alias("shells"), F.sum(F.expr("k * ln(k)")).alias("klnk"))
    top = cores.agg(F.max("coreness").alias("coreness"))
    inner = store(cores.join(F.broadcast(top), "coreness").select("v"))  # one row
    held = g.edges.where("src != dst").join(inner.select(F.col("v").alias("src")), "src", "left_semi").join(inner.select(F.col("v").alias("dst")), "dst", "left_semi").agg(F.count("*").alias("held"))
    return named(beside(a, held), CORES)


TWO_STEPS = {"first_leap_zagreb": "a", "second_leap_zagreb": "b", "third_leap_zagreb": "c", "first_zagreb_connection": "a", "second_zagreb_connection": "b", "modified_first_zagreb_connection": "c"}


def second_degrees(g: Graph) -> DataFrame:
    """(v, d2): the vertices two steps away and not one. Two-step pairs are n times the square of the mean degree by their nature."""
    e = store(g.simple_slots)
    two = e.join(e.select(F.col("v").alias("u"), F.col("u").alias("w")), "u").where("v != w").select("v", F.col("w").alias("u")).distinct()
    far = two.join(e, ["v", "u"], "left_anti").groupBy("v").agg(F.count("*").alias("d2"))
    return g.vertices.select("v").join(far, "v", "left").select("v", F.coalesce("d2", F.lit(0)).cast("double").alias("d2"))


def leap_measures(g: Graph) -> DataFrame:
    """Leap and connection indices, from the second degrees; for simple undirected graphs."""
    v = store(second_degrees(g).join(g.degrees(), "v"))
    ends = g.edges.where("src != dst").join(v.select(F.col("v").alias("src"), F.col("d2").alias("x")), "src").join(v.select(F.col("v").alias("dst"), F.col("d2").alias("y")), "dst")
    return named(beside(v.agg(F.sum(F.expr("d2 * d2")).alias("a"), F.sum(F.expr("d * d2")).alias("c")), ends.agg(F.sum(F.expr("x * y")).alias("b"))), TWO_STEPS)


EDGE_PAIRS = {
    "edge_entropy": "(ln(w) - wlnw / w) / ln(2)", "edge_distribution_entropy": "(ln(m) - klnk / m) / ln(m)", "degree_mixing_entropy": "(ln(m) - klnk / m) / ln(m)", "degree_assortativity_proxy": "r",
}


def edge_distribution_measures(g: Graph) -> DataFrame:
    """Entropies of the degrees at the ends of edges that aren't loops, and their correlation over both directions."""
    e = g.edge_degrees.where("src != dst")
    pairs = e.groupBy(F.least("du", "dv").alias("x"), F.greatest("du", "dv").alias("y")).agg(F.count("*").cast("double").alias("k"))
    a = pairs.agg(F.sum("k").alias("m"), F.sum(F.expr("k * ln(k)")).alias("klnk"), F.sum(F.expr("k / (x * y)")).alias("w"), F.sum(F.expr("k / (x * y) * ln(1 / (x * y))")).alias("wlnw"))
    ends = pairs.select("k", F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("k", "p.x", "p.y")
    moments = ends.agg(F.expr("sum(k * x) / sum(k)").alias("mean"), F.expr("sum(k * x * y) / sum(k)").alias("xy"), F.expr("sum(k * x * x) / sum(k)").alias("xx"))
    b = moments.select(F.expr("case when xx - mean * mean > 1e-12 then (xy - mean * mean) / (xx - mean * mean) end").alias("r"))
    return named(beside(a, b), EDGE_PAIRS)


DISTANCES = {
    "diameter_ratio": "top / (n - 1)", "mean_eccentricity_ratio": "ecc / top", "diameter_radius_ratio": "top / low", "avg_path_fraction": "mean / top", "efficiency_ratio": "inverse", "graph_compactness": "1 - mean / top",
    "distance_skewness": "case when m2 > 1e-30 then m3 / power(m2, 1.5D) end", "distance_kurtosis": "case when m2 > 1e-30 then m4 / (m2 * m2) - 3 end", "hop_entropy": "case when top > 1 then h / ln(top) end", "distance_gini": "gini",
    "reach_decay": "half / (n * (n - 1))", "transmission_ratio": "far / n / far_top", "kirchhoff_index_ratio": "mean / top", "first_transmission_zagreb": "far2", "second_transmission_zagreb": "far_ends", "reciprocal_transmission_index": "far_inverse",
    "lanzhou_index": "dde", "degree_eccentricity_index": "de", "degree_distance_correlation": "r_ecc", "degree_closeness_correlation": "r_close", "closeness_centralization": "(n * close_top - close) / ((n - 2) * (n - 1) / (2 * n - 3))",
    "reciprocal_degree_distance": "rdd", "terminal_wiener_index": "leaves", "wiener_polarity_index": "three", "navigability_ratio": "ln(n) / mean", "clustering_path_ratio": "cc * n / mean", "smallworld_sigma": "(cc / (s / n / n)) / (mean / (ln(n) / ln(s / n)))",
    "smallworld_omega": "ln(n) / ln(s / n) / mean - cc / 0.75D", "layer_ratio": "hub_far / (n - 1) / (n - 1)", "bandwidth_lower_bound": "greatest(ceil(dmax / 2), ceil((n - 1) / top))", "local_efficiency_ratio": "local / n / inverse",
    "periphery_size": "outer", "center_size": "inner",
}


def distance_profile(g: Graph, table: DataFrame) -> DataFrame:
    """Measures of a distance table (s, t, dist) of a connected undirected simple graph: one pass over pairs, one over vertices, one over edges."""
    d = g.degrees().select("v", F.col("d").cast("double").alias("d"))
    hops = store(table.where("s < t").groupBy(F.col("dist").cast("double").alias("x")).agg(F.count("*").cast("double").alias("k")))  # a row for each distance
    whole, up = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    h = hops.withColumn("p", F.sum("k").over(whole)).withColumn("total", F.sum(F.expr("k * x")).over(whole)).withColumn("before", F.coalesce(F.sum("k").over(up), F.lit(0.0))).withColumn("top", F.max("x").over(whole))
    a = h.agg(
        F.max("top").alias("top"), F.expr("sum(k * x) / sum(k)").alias("mean"), F.expr("sum(k / x) / sum(k)").alias("inverse"), F.expr("sum(k * power(x - total / p, 2)) / sum(k)").alias("m2"), F.expr("sum(k * power(x - total / p, 3)) / sum(k)").alias("m3"),
        F.expr("sum(k * power(x - total / p, 4)) / sum(k)").alias("m4"), F.expr("-sum(k / p * ln(k / p))").alias("h"), F.expr("sum(k * x * (2 * before + k - p)) / max(p * total)").alias("gini"),
        F.sum(F.expr("case when x <= floor(top / 2) then 2 * k else 0 end")).alias("half"), F.sum(F.expr("case when x = 3 then k else 0 end")).alias("three"),
    )
    v = table.where("dist > 0").groupBy(F.col("s").alias("v")).agg(F.max("dist").cast("double").alias("ecc"), F.sum("dist").cast("double").alias("far")).join(d, "v")
    v = store(v)
    n = v.agg(F.count("*").cast("double").alias("n"), F.max("ecc").alias("wide"), F.min("ecc").alias("low"))
    w = v.withColumn("_j", F.lit(1)).join(F.broadcast(n.withColumn("_j", F.lit(1))), "_j").withColumn("close", F.expr("(n - 1) / far"))  # one row
    b = w.agg(
        F.max("n").alias("n"), F.max("low").alias("low"), F.avg("ecc").alias("ecc"), F.sum("far").alias("far"), F.max("far").alias("far_top"), F.sum(F.expr("far * far")).alias("far2"), F.sum(F.expr("1 / far")).alias("far_inverse"), F.sum(F.expr("d * d * ecc")).alias("dde"),
        F.sum(F.expr("d * ecc")).alias("de"), F.corr("d", "ecc").alias("r_ecc"), F.corr("d", "close").alias("r_close"), F.max("close").alias("close_top"), F.sum("close").alias("close"), F.sum("d").alias("s"), F.max("d").alias("dmax"),
        F.expr("max_by(far, struct(d, -v))").alias("hub_far"), F.count_if(F.expr("ecc = wide")).alias("outer"), F.count_if(F.expr("ecc = low")).alias("inner"),
    )
    e = g.edges.where("src != dst").join(v.select(F.col("v").alias("src"), F.col("far").alias("x")), "src").join(v.select(F.col("v").alias("dst"), F.col("far").alias("y")), "dst").agg(F.sum(F.expr("x * y")).alias("far_ends"))
    pairs = table.where("s < t").join(d.select(F.col("v").alias("s"), F.col("d").alias("x")), "s").join(d.select(F.col("v").alias("t"), F.col("d").alias("y")), "t")
    p = pairs.agg(F.sum(F.expr("(x + y) / dist")).alias("rdd"), F.sum(F.expr("case when x = 1 and y = 1 then dist end")).alias("leaves"))
    c = clustering(g).agg(F.avg(F.coalesce("transitivity", F.lit(0.0))).alias("cc"))
    near = g.simple_slots
    around = near.join(near.select("v", F.col("u").alias("w")), "v").where("u < w").join(table.select(F.col("s").alias("u"), F.col("t").alias("w"), "dist"), ["u", "w"]).groupBy("v").agg(F.avg(F.expr("1.0D / dist")).alias("x"))
    return named(beside(a, b, e, p, c, around.agg(F.sum("x").alias("local"))), DISTANCES)
