"""Registered queries of the structural profiles and centralities, with SQL written from the definitions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lattica.catalogue import BOTH, COPURCHASE, DEG, PER, TREE, bought, copurchase, f32, register, trade, tree
from lattica.graph import Graph, store
from lattica.operators import distances, iterate, profile

# Nations whose trade with each other, in line items, is above the mean of all pairs that trade; weight: the line items.
PARTNERS = (
    "f AS MATERIALIZED (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS c, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey "
    "WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), e AS MATERIALIZED (SELECT CAST(a AS BIGINT) AS src, CAST(c AS BIGINT) AS dst, CAST(a * 100 + c AS BIGINT) AS eid, CAST(k AS DOUBLE) AS weight FROM f WHERE k > (SELECT avg(k) FROM f)), "
    "vs AS MATERIALIZED (SELECT DISTINCT v FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e))"
)


def partners(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations that trade with each other more than the mean of all pairs that trade; weight: line items."""
    pairs = trade(spark, sf_dir).edges.where("src != dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("c")).agg(F.count("*").cast("double").alias("k"))
    pairs = store(pairs)
    mean = pairs.agg(F.avg("k").alias("mean"))
    e = pairs.join(F.broadcast(mean), F.col("k") > F.col("mean"))  # one row
    return Graph.from_edges(store(e.selectExpr("a as src", "c as dst", "a * 100 + c as eid", "k as weight")))


def rows(sums: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, coalesce({f32(x)}, 0) AS value FROM {source}" for n, x in sums.items())


def scalars(sums: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, coalesce({f32(x)}, 0) AS value" for n, x in sums.items())


# components by propagation along walks; the graphs here have small diameters
_COMP = "cr AS (SELECT v, v AS c FROM vs UNION SELECT b.u, cr.c FROM cr JOIN b ON b.v = cr.v WHERE cr.c < b.u), cp AS (SELECT v, min(c) AS c FROM cr GROUP BY v), cs AS (SELECT c, count(*) AS k FROM cp GROUP BY c), co AS (SELECT count(*) AS c, max(k) AS big, coalesce((SELECT k FROM cs ORDER BY k DESC LIMIT 1 OFFSET 1), 0) AS second FROM cs)"
_N = "s1 AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d) AS s, max(d) AS top, min(d) AS bottom, sum(d * d) AS q, median(d) AS med FROM d), s2 AS (SELECT CAST(count(*) AS DOUBLE) AS m, sum(CASE WHEN src = dst THEN 1 ELSE 0 END) AS loops, count(DISTINCT (src, dst)) AS pairs FROM e)"
_ALL = "FROM s1, s2, co"
_STRUCTURE = {
    "component_ratio": f"(SELECT c / n {_ALL})", "largest_component_fraction": f"(SELECT big / n {_ALL})", "giant_component_gap": f"(SELECT (big - second) / n {_ALL})", "vertex_connectivity_ratio": f"(SELECT bottom / (n - 1) {_ALL})",
    "vertex_conn_ratio": f"(SELECT CASE WHEN c = 1 THEN bottom / (n - 1) END {_ALL})", "edge_conn_ratio": f"(SELECT CASE WHEN c = 1 THEN bottom / (n - 1) END {_ALL})", "min_degree_connectivity_ratio": f"(SELECT CASE WHEN c = 1 THEN bottom * n / s END {_ALL})",
    "self_loop_ratio": f"(SELECT loops / m {_ALL})", "multi_edge_ratio": f"(SELECT (m - pairs) / m {_ALL})", "circuit_rank_ratio": f"(SELECT (m - n + c) / m {_ALL})", "meshedness_coefficient": f"(SELECT CASE WHEN c = 1 THEN (m - n + 1) / (2 * n - 5) END {_ALL})",
    "edge_surplus_ratio": f"(SELECT (m - n + c) / (n * (n - 1) / 2 - n + c) {_ALL})", "edge_connectivity_ratio": f"(SELECT 2 * m / (n * (n - 1)) {_ALL})", "degree_density": f"(SELECT (q / s - 1) / (n - 1) {_ALL})", "cyclomatic_density": f"(SELECT (m - n + c) / n {_ALL})",
    "flow_hierarchy_ratio": f"(SELECT (n - c) / m {_ALL})", "degree_structural_info": "(SELECT (lgamma(max(n) + 1) - sum(lgamma(k + 1))) / ln(2) FROM s1, (SELECT count(*) AS k FROM d GROUP BY d))", "degree_centralization": "(SELECT sum(top - d) / max((n - 1) * (n - 2)) FROM s1, d)",
    "centrality_entropy": "(SELECT -sum(CASE WHEN d > 0 THEN d / s * ln(d / s) ELSE 0 END) FROM s1, d)", "isolated_vertex_ratio": "(SELECT avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END) FROM d)", "degree_median_ad": "(SELECT median(abs(d - med)) FROM s1, d)",
    "regularity": "(SELECT CASE WHEN top = bottom THEN top END FROM s1)", "count_loops": "(SELECT loops FROM s2)", "satisfies_dirac": "(SELECT CASE WHEN n >= 3 AND 2 * bottom >= n THEN 1 ELSE 0 END FROM s1)", "centralization_degree": "(SELECT n * top - s FROM s1)",
    "max_flow_efficiency": "(SELECT CASE WHEN bottom > 0 THEN (SELECT avg(least(x.d, y.d)) FROM d x JOIN d y ON x.v < y.v) / bottom END FROM s1)", "bandwidth_lower_bound_by_degree": "(SELECT ceil(top / 2) FROM s1)",
}
for _name, _graph, _sql in (("structure_ratios", copurchase, COPURCHASE), ("structure_ratios_partners", partners, PARTNERS), ("structure_ratios_tree", tree, TREE)):
    register(_name, f"WITH RECURSIVE {_sql}, {DEG}, {_COMP}, {_N} " + scalars(_STRUCTURE))(lambda s, p, g=_graph: profile.structure_ratios(g(s, p)))

_NB = "nb AS (SELECT b.v, max(d.d) AS mx, min(d.d) AS mn, var_pop(d.d) AS var, avg(d.d) AS mean, sum(d.d) AS s FROM b JOIN d ON d.v = b.u GROUP BY 1), nv AS (SELECT d.v, d.d, nb.*  EXCLUDE (v), nb.s - cl.triangles AS ve FROM d JOIN nb ON nb.v = d.v JOIN cl ON cl.v = d.v), ne AS (SELECT x.s AS x, y.s AS y, x.ve AS p, y.ve AS q FROM e JOIN nv x ON x.v = e.src JOIN nv y ON y.v = e.dst)"
_NEIGHBOURS = {
    "degree_neighbor_max_sum": "sum(mx)", "degree_neighbor_min_sum": "sum(mn)", "degree_neighbor_range_sum": "sum(mx - mn)", "degree_neighbor_variance_sum": "sum(var)", "avg_neighbor_degree_ratio": "avg(mean / d)", "neighbor_degree_disparity": "avg(mean / d)",
    "neighbor_connectivity_ratio": "avg(mn / mx)", "degree_neighbor_correlation": "corr(d, mean)", "avg_neighbor_connectivity": "avg(mean)", "first_neighborhood_zagreb": "sum(s * s)", "neighborhood_forgotten_index": "sum(s * s * s)", "first_ve_degree_zagreb_alpha": "sum(ve * ve)",
}
_NEIGHBOUR_ENDS = {"second_neighborhood_zagreb": "sum(x * y)", "first_ve_degree_zagreb_beta": "sum(p + q)", "second_ve_degree_zagreb": "sum(p * q)"}
_ADJACENT = "fe AS (SELECT src, dst, du + dv - 2 AS e FROM ed), fp AS (SELECT x.e AS x, y.e AS y FROM fe x JOIN fe y ON (x.src, x.dst) < (y.src, y.dst) AND (x.src = y.src OR x.src = y.dst OR x.dst = y.src OR x.dst = y.dst))"
_OV = "ov AS (SELECT ed.src, ed.dst, ed.du, ed.dv, (SELECT count(*) FROM b x JOIN b y ON x.u = y.u WHERE x.v = ed.src AND y.v = ed.dst) AS t FROM ed)"
_OVERLAP = {
    "edge_common_neighbor_sum": "sum(t)", "edge_jaccard_sum": "sum(t / nullif(du + dv - 2 - t, 0))", "edge_overlap_sum": "sum(t / nullif(least(du, dv) - 1, 0))", "mean_forman_ricci": "avg(4 - du - dv + 3 * t)", "min_forman_ricci": "min(4 - du - dv + 3 * t)",
    "max_forman_ricci": "max(4 - du - dv + 3 * t)", "pendant_edge_ratio": "avg(CASE WHEN least(du, dv) = 1 THEN 1.0 ELSE 0 END)", "average_sombor_index": "avg(sqrt(du * du + dv * dv))",
}
_OVERLAP_V = {"edge_adamic_adar_sum": "sum(CASE WHEN degree > 1 THEN triangles / ln(degree) END)", "triangle_participation": "avg(CASE WHEN triangles > 0 THEN 1.0 ELSE 0 END)", "triangle_density": "2 * sum(triangles) / (count(*) * (count(*) - 1.0) * (count(*) - 2.0))"}
_CL = "ce AS (SELECT degree, triangles, transitivity AS c FROM cl WHERE degree >= 2), cm AS (SELECT avg(c) AS mean, CAST(count(*) AS DOUBLE) AS k, var_pop(c) AS var FROM ce), cq AS (SELECT avg(power(c - mean, 3)) AS m3, avg(power(c - mean, 4)) AS m4 FROM ce, cm), cb AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS x FROM ce GROUP BY 1)"
_CLUSTERING = {
    "clustering_variance": "(SELECT var FROM cm)", "clustering_bimodality": "(SELECT CASE WHEN var > 1e-30 THEN (power(m3 / power(var, 1.5), 2) + 1) / (m4 / (var * var)) END FROM cm, cq)", "clustering_degree_correlation": "(SELECT CASE WHEN max(var) > 1e-30 THEN corr(degree, c) END FROM ce, cm)",
    "transitivity_gap": "(SELECT sum(triangles) / sum(degree * (degree - 1) / 2) - avg(c) FROM ce)", "closed_triplet_ratio": "(SELECT sum(triangles) / sum(degree * (degree - 1) / 2) FROM ce)", "local_density_ratio": "(SELECT mean FROM cm)",
    "odd_cycle_density": "(SELECT sum(triangles) / sum(degree * (degree - 1) / 2) FROM ce)", "clustering_entropy": "(SELECT CASE WHEN count(*) > 1 THEN -sum(x / k * ln(x / k)) / ln(count(*)) END FROM cb, cm)",
}
_EP = "ep AS (SELECT least(du, dv) AS x, greatest(du, dv) AS y, CAST(count(*) AS DOUBLE) AS k FROM ed GROUP BY 1, 2), em AS (SELECT CAST(count(*) AS DOUBLE) AS m, sum(1 / (du * dv)) AS w FROM ed), ee AS (SELECT du AS x, dv AS y FROM ed UNION ALL SELECT dv, du FROM ed)"
_EDGE_PAIRS = {
    "edge_entropy": "(SELECT -sum(1 / (du * dv) / w * log2(1 / (du * dv) / w)) FROM ed, em)", "edge_distribution_entropy": "(SELECT -sum(k / m * ln(k / m)) / max(ln(m)) FROM ep, em)", "degree_mixing_entropy": "(SELECT -sum(k / m * log2(k / m)) / max(log2(m)) FROM ep, em)",
    "degree_assortativity_proxy": "(SELECT CASE WHEN var_pop(x) > 1e-12 THEN covar_pop(x, y) / var_pop(x) END FROM ee)",
}
_TWO = "tw AS (SELECT vs.v, (SELECT count(DISTINCT y.u) FROM b x JOIN b y ON y.v = x.u WHERE x.v = vs.v AND y.u <> vs.v AND y.u NOT IN (SELECT z.u FROM b z WHERE z.v = vs.v)) AS k FROM vs)"
_LEAP = {"first_leap_zagreb": "(SELECT sum(k * k) FROM tw)", "second_leap_zagreb": "(SELECT sum(x.k * y.k) FROM e JOIN tw x ON x.v = e.src JOIN tw y ON y.v = e.dst)", "third_leap_zagreb": "(SELECT sum(k * d) FROM tw JOIN d ON d.v = tw.v)"}
_LEAP |= {"first_zagreb_connection": _LEAP["first_leap_zagreb"], "second_zagreb_connection": _LEAP["second_leap_zagreb"], "modified_first_zagreb_connection": _LEAP["third_leap_zagreb"]}
for _end, _graph, _lists, _sql in (("", copurchase, bought, COPURCHASE), ("_partners", partners, partners, PARTNERS)):
    register(f"neighbor_degree_measures{_end}", f"WITH {_sql}, {DEG}, {PER}, {_NB} " + rows(_NEIGHBOURS, "nv") + " UNION ALL " + rows(_NEIGHBOUR_ENDS, "ne"))(lambda s, p, g=_lists: profile.neighbor_degree_measures(g(s, p)))
    register(f"edge_distribution_measures{_end}", f"WITH {_sql}, {DEG}, {_EP} " + scalars(_EDGE_PAIRS))(lambda s, p, g=_graph: profile.edge_distribution_measures(g(s, p)))
    register(f"clustering_profile{_end}", f"WITH {_sql}, {DEG}, {PER}, {_CL} " + scalars(_CLUSTERING))(lambda s, p, g=_lists: profile.clustering_profile(g(s, p)))
for _end, _graph, _sql in (("_partners", partners, PARTNERS), ("_tree", tree, TREE)):
    register(f"adjacent_edge_measures{_end}", f"WITH {_sql}, {DEG}, {_ADJACENT} " + rows({"second_reformulated_zagreb": "sum(x * y)", "second_ev_degree_zagreb": "sum(x * y)", "ev_degree_randic": "sum(CASE WHEN x > 0 AND y > 0 THEN 1 / sqrt(x * y) END)"}, "fp"))(lambda s, p, g=_graph: profile.adjacent_edge_measures(g(s, p)))
    register(f"edge_overlap_measures{_end}", f"WITH {_sql}, {DEG}, {PER}, {_OV} " + rows(_OVERLAP, "ov") + " UNION ALL " + rows(_OVERLAP_V, "cl"))(lambda s, p, g=_graph: profile.edge_overlap_measures(g(s, p)))
    register(f"leap_measures{_end}", f"WITH {_sql}, {DEG}, {_TWO} " + scalars(_LEAP))(lambda s, p, g=_graph: profile.leap_measures(g(s, p)))
register("forman_ricci_curvature", f"WITH {PARTNERS}, {DEG}, {_OV} SELECT src AS a, dst AS b, {f32('4 - du - dv + 3 * t')} AS curvature FROM ov")(lambda s, p: profile.forman_ricci_curvature(partners(s, p)).select("a", "b", "curvature"))

# coreness by repeated h-indices of the neighbours' values, which settle on it from above
_HS = "h0 AS (SELECT v, d AS c FROM d)" + "".join(
    f", h{i} AS MATERIALIZED (SELECT v, max(least(c, r)) AS c FROM (SELECT b.v, h.c, row_number() OVER (PARTITION BY b.v ORDER BY h.c DESC) AS r FROM b JOIN h{i - 1} h ON h.v = b.u) GROUP BY v)" for i in range(1, 16)
)
_CS = "sh AS (SELECT c, CAST(count(*) AS DOUBLE) AS k FROM h15 GROUP BY c), sm AS (SELECT sum(k) AS n, max(c) AS top, sum(c * k) / sum(k) AS mean, count(*) AS shells FROM sh), si AS (SELECT h15.v FROM h15, sm WHERE c = top)"
_CORES = {
    "degeneracy": "(SELECT top FROM sm)", "core_ratio": "(SELECT k / n FROM sh, sm WHERE c = top)", "core_density": "(SELECT 2.0 * (SELECT count(*) FROM e WHERE src IN (SELECT v FROM si) AND dst IN (SELECT v FROM si)) / (count(*) * (count(*) - 1)) FROM si)",
    "periphery_fraction": "(SELECT sum(CASE WHEN c = 1 THEN k ELSE 0 END) / max(n) FROM sh, sm)", "core_periphery_gradient": "(SELECT (top - 1) / (n - 1) FROM sm)", "core_persistence": "(SELECT mean / top FROM sm)",
    "shell_diversity": "(SELECT CASE WHEN count(*) > 1 THEN -sum(k / n * ln(k / n)) / ln(count(*)) END FROM sh, sm)", "degeneracy_gap": "(SELECT (top - mean) / top FROM sm)",
}
register("core_profile", f"WITH {PARTNERS}, {DEG}, {_HS}, {_CS} " + scalars(_CORES))(lambda s, p: profile.core_profile(g := partners(s, p), store(iterate.coreness(g))))
register("coreness_partners", f"WITH {PARTNERS}, {DEG}, {_HS} SELECT v, CAST(c AS BIGINT) AS coreness FROM h15")(lambda s, p: iterate.coreness(partners(s, p)))

# all distances, from walks of up to eight steps
AP = "wk AS (SELECT v AS s, v AS t, 0 AS dist FROM vs UNION SELECT wk.s, b.u, wk.dist + 1 FROM wk JOIN b ON b.v = wk.t WHERE wk.dist < 8), ap AS MATERIALIZED (SELECT s, t, CAST(min(dist) AS DOUBLE) AS dist FROM wk GROUP BY 1, 2)"
_VD = "vd AS (SELECT d.v, d.d, max(dist) AS ecc, sum(dist) AS far, (SELECT count(*) - 1 FROM vs) / sum(dist) AS close FROM ap JOIN d ON d.v = ap.s GROUP BY 1, 2), pd AS (SELECT dist AS x FROM ap WHERE s < t), pm AS (SELECT avg(x) AS mean, max(x) AS top, CAST(count(*) AS DOUBLE) AS p, var_pop(x) AS var, avg(1 / x) AS inverse FROM pd), nn AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d) AS s, min(ecc) AS low, max(ecc) AS top, max(d) AS dmax FROM vd), ca AS (SELECT avg(coalesce(transitivity, 0)) AS cc FROM cl)"
_DISTANCES = {
    "diameter_ratio": "(SELECT top / (n - 1) FROM nn)", "mean_eccentricity_ratio": "(SELECT avg(ecc) / max(ecc) FROM vd)", "diameter_radius_ratio": "(SELECT top / low FROM nn)", "avg_path_fraction": "(SELECT mean / top FROM pm)", "efficiency_ratio": "(SELECT inverse FROM pm)",
    "graph_compactness": "(SELECT 1 - mean / top FROM pm)", "distance_skewness": "(SELECT avg(power(x - mean, 3)) / max(power(var, 1.5)) FROM pd, pm)", "distance_kurtosis": "(SELECT avg(power(x - mean, 4)) / max(var * var) - 3 FROM pd, pm)",
    "hop_entropy": "(SELECT CASE WHEN max(top) > 1 THEN -sum(k / p * ln(k / p)) / max(ln(top)) END FROM pm, (SELECT x, count(*) AS k FROM pd GROUP BY x))", "distance_gini": "(SELECT sum((2 * i - p - 1) * x) / max(p * p * mean) FROM pm, (SELECT x, row_number() OVER (ORDER BY x) AS i FROM pd))",
    "reach_decay": "(SELECT sum(CASE WHEN ap.s <> ap.t AND dist <= floor(top / 2) THEN 1 ELSE 0 END) / max(n * (n - 1)) FROM ap, nn)", "transmission_ratio": "(SELECT avg(far) / max(far) FROM vd)", "kirchhoff_index_ratio": "(SELECT mean / top FROM pm)",
    "first_transmission_zagreb": "(SELECT sum(far * far) FROM vd)", "second_transmission_zagreb": "(SELECT sum(x.far * y.far) FROM e JOIN vd x ON x.v = e.src JOIN vd y ON y.v = e.dst)", "reciprocal_transmission_index": "(SELECT sum(1 / far) FROM vd)",
    "lanzhou_index": "(SELECT sum(d * d * ecc) FROM vd)", "degree_eccentricity_index": "(SELECT sum(d * ecc) FROM vd)", "degree_distance_correlation": "(SELECT corr(d, ecc) FROM vd)", "degree_closeness_correlation": "(SELECT corr(d, close) FROM vd)",
    "closeness_centralization": "(SELECT (max(n) * max(close) - sum(close)) / max((n - 2) * (n - 1) / (2 * n - 3)) FROM vd, nn)", "reciprocal_degree_distance": "(SELECT sum((x.d + y.d) / dist) FROM ap JOIN d x ON x.v = s JOIN d y ON y.v = t WHERE s < t)",
    "terminal_wiener_index": "(SELECT sum(dist) FROM ap JOIN d x ON x.v = s JOIN d y ON y.v = t WHERE s < t AND x.d = 1 AND y.d = 1)", "wiener_polarity_index": "(SELECT count(*) FROM pd WHERE x = 3)", "navigability_ratio": "(SELECT ln(n) / mean FROM nn, pm)",
    "clustering_path_ratio": "(SELECT cc * n / mean FROM nn, pm, ca)", "smallworld_sigma": "(SELECT (cc / (s / n / n)) / (mean / (ln(n) / ln(s / n))) FROM nn, pm, ca)", "smallworld_omega": "(SELECT ln(n) / ln(s / n) / mean - cc / 0.75 FROM nn, pm, ca)",
    "layer_ratio": "(SELECT far / (n - 1) / (n - 1) FROM vd, nn ORDER BY d DESC, v LIMIT 1)", "bandwidth_lower_bound": "(SELECT greatest(ceil(dmax / 2), ceil((n - 1) / top)) FROM nn)",
    "local_efficiency_ratio": "(SELECT sum(x) / max(n) / max(inverse) FROM nn, pm, (SELECT avg(1 / dist) AS x FROM b x JOIN b y ON x.v = y.v AND x.u < y.u JOIN ap ON ap.s = x.u AND ap.t = y.u GROUP BY x.v))",
    "periphery_size": "(SELECT count(*) FROM vd, nn WHERE ecc = top)", "center_size": "(SELECT count(*) FROM vd, nn WHERE ecc = low)",
}
register("distance_profile", f"WITH RECURSIVE {PARTNERS}, {DEG}, {PER}, {AP}, {_VD} " + scalars(_DISTANCES))(lambda s, p: profile.distance_profile(g := partners(s, p), store(distances.distances(g))))
register("distances_partners", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT s, t, CAST(dist AS INTEGER) AS dist FROM ap")(lambda s, p: distances.distances(partners(s, p)).select("s", "t", "dist"))

