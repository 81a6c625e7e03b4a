"""Registered queries of matrices, look-ups, summaries and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalogue import BOTH, COPURCHASE, DEG, TRADE, copurchase, f32, register, trade
from lattica.catalogue_centrality import BW, _SIG, _signal
from lattica.catalogue_profiles import _COMP, _N, PARTNERS, partners
from lattica.operators import access, spectral

register("get_adjacency", f"WITH {TRADE} SELECT src AS v, dst AS u, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY 1, 2")(lambda s, p: access.get_adjacency(trade(s, p)))
register("get_laplacian", f"WITH {PARTNERS}, {BW} SELECT v, u, {f32('-w')} AS value FROM bw UNION ALL SELECT v, v, {f32('sum(w)')} FROM bw GROUP BY v")(lambda s, p: access.get_laplacian(partners(s, p), "weight"))
register("get_laplacian_symmetric", f"WITH {PARTNERS}, {BW}, k AS (SELECT v, sum(w) AS k FROM bw GROUP BY v) SELECT bw.v, bw.u, {f32('-w / sqrt(x.k * y.k)')} AS value FROM bw JOIN k x ON x.v = bw.v JOIN k y ON y.v = bw.u UNION ALL SELECT v, v, 1.0 FROM k")(lambda s, p: access.get_laplacian(partners(s, p), "weight", "symmetric"))
register("get_stochastic", f"WITH {TRADE} SELECT src AS v, dst AS u, {f32('count(*) / sum(count(*)) OVER (PARTITION BY src)')} AS value FROM e GROUP BY 1, 2")(lambda s, p: access.get_stochastic(trade(s, p)))
register("get_stochastic_columns", f"WITH {TRADE} SELECT src AS v, dst AS u, {f32('count(*) / sum(count(*)) OVER (PARTITION BY dst)')} AS value FROM e GROUP BY 1, 2")(lambda s, p: access.get_stochastic(trade(s, p), None, True))
register("get_biadjacency", f"WITH {PARTNERS}, {BW} SELECT v, u, w AS value FROM bw WHERE v % 2 = 0 AND u % 2 = 1")(lambda s, p: access.get_biadjacency(g := partners(s, p), g.vertices.selectExpr("v", "v % 2 = 1 as type"), "weight"))
_PAIRS = "pr AS (SELECT x.v AS a, y.v AS b FROM vs x, vs y WHERE x.v <= y.v)"
_pairs = lambda g: g.vertices.select(F.col("v").alias("a")).join(g.vertices.select(F.col("v").alias("b")), F.col("a") <= F.col("b"))
register("are_adjacent", f"WITH {PARTNERS}, {BOTH}, {_PAIRS} SELECT a, b, EXISTS (SELECT 1 FROM b AS z WHERE z.v = pr.a AND z.u = pr.b) AS adjacent FROM pr")(lambda s, p: access.are_adjacent(g := partners(s, p), _pairs(g)))
register("get_eids", f"WITH {PARTNERS}, {_PAIRS} SELECT a, b, (SELECT min(eid) FROM e WHERE src = a AND dst = b) AS eid FROM pr")(lambda s, p: access.get_eids(g := partners(s, p), _pairs(g)))
_SIM = f"{_PAIRS}, sm AS (SELECT pr.a, pr.b, (SELECT count(*) FROM b x JOIN b y ON x.u = y.u WHERE x.v = pr.a AND y.v = pr.b) AS k, (SELECT sum(CASE WHEN z.d > 1 THEN 1 / ln(z.d) END) FROM b x JOIN b y ON x.u = y.u JOIN d z ON z.v = x.u WHERE x.v = pr.a AND y.v = pr.b) AS il, p.d AS x, q.d AS y FROM pr JOIN d p ON p.v = pr.a JOIN d q ON q.v = pr.b)"
register("pair_similarities", f"WITH {PARTNERS}, {DEG}, {_SIM} SELECT a, b, CASE WHEN a = b THEN 1 ELSE {f32('k / (x + y - k)')} END AS jaccard, CASE WHEN a = b THEN 1 ELSE {f32('2 * k / (x + y)')} END AS dice, CASE WHEN a = b THEN 0 ELSE coalesce({f32('il')}, 0) END AS inverse_log FROM sm")(
    lambda s, p: access.pair_similarities(g := partners(s, p), _pairs(g))
)
register("edge_similarities", f"WITH {PARTNERS}, {DEG}, {_SIM} SELECT eid, {f32('k / (x + y - k)')} AS jaccard, {f32('2 * k / (x + y)')} AS dice FROM e JOIN sm ON sm.a = src AND sm.b = dst")(lambda s, p: access.edge_similarities(partners(s, p)))
for _mode, _side in (("out", "SELECT src AS v FROM e"), ("in", "SELECT dst AS v FROM e"), ("all", "SELECT src AS v FROM e UNION ALL SELECT dst FROM e")):
    register(f"degree_sequence_{_mode}", f"WITH {TRADE} SELECT vs.v, count(z.v) AS degree FROM vs LEFT JOIN ({_side}) z ON z.v = vs.v GROUP BY 1")(lambda s, p, m=_mode: access.degree_sequence(trade(s, p), m))
register("max_degree_vertex", f"WITH {COPURCHASE}, {DEG} SELECT v, CAST(d AS BIGINT) AS degree FROM d ORDER BY d DESC, v LIMIT 1")(lambda s, p: access.max_degree_vertex(copurchase(s, p)))
register("strength_with_mode", f"WITH {TRADE} SELECT vs.v, coalesce(CAST(sum(CASE WHEN src <> dst THEN 1 END) AS DOUBLE), 0) AS strength FROM vs LEFT JOIN e ON e.src = vs.v GROUP BY 1")(
    lambda s, p: access.strength_with_mode(_counted(trade(s, p)), "weight", "out", False)
)
register("reciprocity_ratio", f"WITH {TRADE}, a AS (SELECT DISTINCT src, dst FROM e) SELECT {f32('(SELECT count(*) FROM a x JOIN a y ON x.src = y.dst AND x.dst = y.src) / count(*)')} AS reciprocity_ratio FROM e")(lambda s, p: access.reciprocity_ratio(trade(s, p)))
register("normalized_dirichlet_energy", f"WITH {PARTNERS}, {_SIG} SELECT {f32('sum(weight * power(x.x - y.x, 2)) / sum(weight * (x.x * x.x + y.x * y.x))')} AS energy FROM e JOIN x0 x ON x.v = src JOIN x0 y ON y.v = dst")(lambda s, p: access.normalized_dirichlet_energy(g := partners(s, p), _signal(g), "weight"))
_SUMMARY = {"vertices": "n", "edges": "m", "directed": "0.0", "density": "2 * m / (n * (n - 1))", "min_degree": "bottom", "max_degree": "top", "mean_degree": "s / n", "components": "c", "is_connected": "CASE WHEN c = 1 THEN 1 ELSE 0 END", "self_loops": "loops", "multi_edges": "m - pairs"}
register("graph_summary", f"WITH RECURSIVE {COPURCHASE}, {DEG}, {_COMP}, {_N} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {f32(x)} AS value FROM s1, s2, co" for n, x in _SUMMARY.items()))(lambda s, p: access.graph_summary(copurchase(s, p)))
register("local_scan_subsets", f"WITH {PARTNERS}, ss AS (SELECT v, v % 4 AS subset FROM vs) SELECT x.subset, {f32('coalesce((SELECT sum(weight) FROM e JOIN ss a ON a.v = src JOIN ss b ON b.v = dst WHERE a.subset = x.subset AND b.subset = x.subset), 0)')} AS scan FROM (SELECT DISTINCT subset FROM ss) x")(lambda s, p: access.local_scan_subsets(g := partners(s, p), g.vertices.selectExpr("v", "v % 4 as subset"), "weight"))

# the exponential of the adjacency as a sum over walks
_EXP = "ex AS (SELECT v AS s, v AS t, 0 AS i, 1.0::DOUBLE AS x FROM vs UNION ALL SELECT ex.s, b.u, ex.i + 1, sum(ex.x) / (ex.i + 1) FROM ex JOIN b ON b.v = ex.t WHERE ex.i < 120 GROUP BY ex.s, b.u, ex.i)"
register("communicability", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_EXP} SELECT s AS v, t AS u, {f32('sum(x)')} AS value FROM ex GROUP BY 1, 2")(lambda s, p: spectral.communicability(partners(s, p)))
register("subgraph_centrality", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_EXP} SELECT s AS v, {f32('sum(x)')} AS centrality FROM ex WHERE s = t GROUP BY 1")(lambda s, p: spectral.subgraph_centrality(partners(s, p)))
# traces: sums of eigenvalues and of their squares are sums over the matrices
register("spectrum_traces", f"WITH {PARTNERS}, {DEG} SELECT k.kind, {f32('k.one')} AS one, {f32('k.two')} AS two FROM (SELECT 'adjacency' AS kind, 0.0 AS one, (SELECT sum(d) FROM d) AS two UNION ALL SELECT 'laplacian', (SELECT sum(d) FROM d), (SELECT sum(d * d + d) FROM d) UNION ALL SELECT 'signless', (SELECT sum(d) FROM d), (SELECT sum(d * d + d) FROM d) UNION ALL SELECT 'normalized', (SELECT count(*) FROM d), (SELECT count(*) FROM d) + (SELECT 2 * sum(1 / (du * dv)) FROM ed)) k")(
    lambda s, p: spectral.spectra(partners(s, p), ("adjacency", "laplacian", "signless", "normalized")).groupBy("kind").agg(F.round(F.sum("value"), 6).alias("one"), F.sum(F.col("value") * F.col("value")).alias("two"))
)
# resistances along edges sum to n less the components (Foster)
register("resistance_total", f"WITH {PARTNERS} SELECT CAST(count(*) - 1 AS DOUBLE) AS total FROM vs")(lambda s, p: spectral.effective_resistances(g := partners(s, p)).join(g.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), ["u", "v"]).agg(F.sum("resistance").alias("total")))
for _name, _made in (
    ("spectral_profile", lambda g: spectral.spectral_profile(g)), ("resistance_centrality", lambda g: spectral.resistance_centrality(g)), ("effective_resistances", lambda g: spectral.effective_resistances(g)), ("adjacency_spectral_embedding", lambda g: spectral.adjacency_spectral_embedding(g, 3)),
    ("laplacian_spectral_embedding", lambda g: spectral.laplacian_spectral_embedding(g, 3)), ("eigen_adjacency", lambda g: spectral.eigen_adjacency(g, 4, "LM")), ("distance_spectrum", lambda g: spectral.spectra(g, ("distance",))),
):
    register(_name, None)(lambda s, p, f=_made: f(partners(s, p)))


def _counted(g):
    from lattica.graph import Graph

    return Graph(g.vertices, g.edges.withColumn("weight", F.lit(1.0)), g.directed)
