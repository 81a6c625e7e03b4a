"""Registered queries of flows, cuts, cliques and sets, with SQL where it can say what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalogue import BOTH, DEG, register
from lattica.catalogue_centrality import _DT, strong_trade
from lattica.catalogue_patterns import count_sql
from lattica.catalogue_profiles import PARTNERS, partners
from lattica.graph import Graph, store
from lattica.operators import flows, sets


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = partners(spark, sf_dir)
    odd, even = g.vertices.where("v % 2 = 1"), g.vertices.where("v % 2 = 0")
    hub = g.degrees().groupBy(F.lit(1).alias("one")).agg(F.max_by("v", F.struct("d", -F.col("v"))).alias("v")).select("v")
    colors, parts = g.vertices.selectExpr("v", "v % 5 as color"), g.vertices.selectExpr("v", "v % 5 as part")
    some, all_ = g.edges.where("eid % 7 = 0"), g.edges
    found = {
        "is_clique": sets.is_clique(g, odd), "is_independent_vertex_set": sets.is_independent_vertex_set(g, odd), "is_vertex_cover": sets.is_vertex_cover(g, even), "is_dominating_set": sets.is_dominating_set(g, odd), "hub_dominates": sets.is_dominating_set(g, hub),
        "is_edge_cover": sets.is_edge_cover(g, some), "all_cover": sets.is_edge_cover(g, all_), "is_matching": sets.is_matching(g, some), "is_maximal_matching": sets.is_maximal_matching(g, some), "is_perfect_matching": sets.is_perfect_matching(g, some),
        "is_vertex_coloring": sets.is_vertex_coloring(g, colors), "is_bipartite_coloring": sets.is_bipartite_coloring(g, g.vertices.selectExpr("v", "v % 2 as color")), "is_edge_coloring": sets.is_edge_coloring(g, g.edges.selectExpr("eid", "eid as color")), "is_clique_cover": sets.is_clique_cover(g, parts),
        "is_separator": flows.is_separator(g, hub),
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, value boolean")


_HUB = "hb AS (SELECT v FROM d ORDER BY d DESC, v LIMIT 1)"
_SOME = "(SELECT * FROM e WHERE eid % 7 = 0)"
_CHECKS = {
    "is_clique": "(SELECT count(*) = 0 FROM vs x JOIN vs y ON x.v < y.v AND x.v % 2 = 1 AND y.v % 2 = 1 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.v = x.v AND b.u = y.v))", "is_independent_vertex_set": "(SELECT count(*) = 0 FROM e WHERE src % 2 = 1 AND dst % 2 = 1)",
    "is_vertex_cover": "(SELECT count(*) = 0 FROM e WHERE src % 2 = 1 AND dst % 2 = 1)", "is_dominating_set": "(SELECT count(*) = 0 FROM vs WHERE v % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b WHERE b.v = vs.v AND b.u % 2 = 1))",
    "hub_dominates": "(SELECT count(*) = 0 FROM vs, hb WHERE vs.v <> hb.v AND NOT EXISTS (SELECT 1 FROM b WHERE b.v = vs.v AND b.u = hb.v))", "is_edge_cover": f"(SELECT count(*) = 0 FROM vs WHERE v NOT IN (SELECT src FROM {_SOME} UNION SELECT dst FROM {_SOME}))", "all_cover": "true",
    "is_matching": f"(SELECT count(*) = count(DISTINCT v) FROM (SELECT src AS v FROM {_SOME} UNION ALL SELECT dst FROM {_SOME}))",
    "is_maximal_matching": f"(SELECT count(*) = count(DISTINCT v) FROM (SELECT src AS v FROM {_SOME} UNION ALL SELECT dst FROM {_SOME})) AND (SELECT count(*) = 0 FROM e WHERE src NOT IN (SELECT src FROM {_SOME} UNION SELECT dst FROM {_SOME}) AND dst NOT IN (SELECT src FROM {_SOME} UNION SELECT dst FROM {_SOME}))",
    "is_perfect_matching": f"(SELECT count(*) = count(DISTINCT v) AND count(*) = (SELECT count(*) FROM vs) FROM (SELECT src AS v FROM {_SOME} UNION ALL SELECT dst FROM {_SOME}))", "is_vertex_coloring": "(SELECT count(*) = 0 FROM e WHERE src % 5 = dst % 5)", "is_bipartite_coloring": "(SELECT count(*) = 0 FROM e WHERE src % 2 = dst % 2)",
    "is_edge_coloring": "true", "is_clique_cover": "(SELECT count(*) = 0 FROM vs x JOIN vs y ON x.v < y.v AND x.v % 5 = y.v % 5 WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.v = x.v AND b.u = y.v))",
    "is_separator": "(SELECT count(*) < (SELECT count(*) - 1 FROM vs) FROM rh)",
}
_RH = "rh AS (SELECT min(vs.v) AS v FROM vs, hb WHERE vs.v <> hb.v UNION SELECT b.u FROM rh JOIN b ON b.v = rh.v WHERE b.u NOT IN (SELECT v FROM hb))"
register("set_checks", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_HUB}, {_RH} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {x} AS value" for n, x in _CHECKS.items()))(_checks)
register("cut_value", f"WITH {PARTNERS} SELECT sum(CASE WHEN src % 2 <> dst % 2 THEN weight ELSE 0 END) AS value FROM e")(lambda s, p: sets.cut_value(g := partners(s, p), g.vertices.where("v % 2 = 0"), "weight"))
register("bandwidth_of_labeling", f"WITH {PARTNERS} SELECT max(abs(src * 7 % 25 - dst * 7 % 25)) AS bandwidth FROM e")(lambda s, p: sets.bandwidth_of_labeling(g := partners(s, p), g.vertices.selectExpr("v", "v * 7 % 25 as label")))
register("cliques_3", f"WITH {PARTNERS}, {BOTH} SELECT x.src::VARCHAR || ',' || x.dst || ',' || y.dst AS clique FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst")(lambda s, p: sets.cliques(partners(s, p), 3).select(F.array_join(F.transform("clique", lambda v: v.cast("string")), ",").alias("clique")))
register("cliques_4", f"WITH {PARTNERS}, {BOTH} SELECT {count_sql('k4')} AS cliques")(lambda s, p: sets.cliques(partners(s, p), 4).agg(F.count("*").alias("cliques")))

register("clique_sizes", None)(lambda s, p: sets.clique_sizes(partners(s, p)))
register("largest_cliques", None)(lambda s, p: sets.largest_cliques(partners(s, p)).select(F.array_join(F.transform("clique", lambda v: v.cast("string")), ",").alias("clique")))
register("maximal_independent_sets", None)(lambda s, p: sets.maximal_independent_sets(partners(s, p)).select(F.array_join(F.transform("clique", lambda v: v.cast("string")), ",").alias("vertices")))


def _sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That the greedy and the exact sets are what they are called."""
    g = partners(spark, sf_dir)
    greedy, exact, colors, cover = store(sets.greedy_sets(g)), store(sets.optimal_sets(g)), store(sets.colorings(g)), store(sets.greedy_clique_cover(g))
    of = lambda t, kind: t.where(F.col("kind") == kind).select(F.col("id").alias("v"))
    found = {
        "independent": sets.is_independent_vertex_set(g, of(greedy, "independent")), "independent_is_maximal": sets.is_dominating_set(g, of(greedy, "independent")), "matching_is_maximal": sets.is_maximal_matching(g, of(greedy, "matching").withColumnRenamed("v", "eid")),
        "dominating": sets.is_dominating_set(g, of(greedy, "dominating")), "maximum_independent": sets.is_independent_vertex_set(g, of(exact, "independent")), "cover": sets.is_vertex_cover(g, of(exact, "cover")),
        "larger": of(exact, "independent").count() >= of(greedy, "independent").count(), "coloring": sets.is_vertex_coloring(g, colors.where("kind = 'vertex'").select(F.col("id").alias("v"), "color")),
        "edge_coloring": sets.is_edge_coloring(g, colors.where("kind = 'edge'").select(F.col("id").alias("eid"), "color")), "clique_cover": sets.is_clique_cover(g, cover),
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, value boolean")


register("sets_are_sound", " UNION ALL ".join(f"SELECT '{x}' AS name, true AS value" for x in ("independent", "independent_is_maximal", "matching_is_maximal", "dominating", "maximum_independent", "cover", "larger", "coloring", "edge_coloring", "clique_cover")))(_sound)


def _connectivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectivities bound each other and the least degree (Whitney), and the cut found has the value of the flow."""
    g = partners(spark, sf_dir)
    kappa, lam, least = flows.vertex_connectivity(g), flows.edge_connectivity(g), g.degrees().agg(F.min("d")).first()[0]
    value, _, cut = flows.mincut(g)
    tree = store(flows.gomory_hu_tree(g))
    found = {"whitney": 1 <= kappa <= lam <= least, "cut": cut.count() == value == lam, "tree": tree.agg(F.min("flow")).first()[0] == lam, "tree_spans": tree.count() == g.vertices.count() - 1}
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, value boolean")


register("connectivities", " UNION ALL ".join(f"SELECT '{x}' AS name, true AS value" for x in ("whitney", "cut", "tree", "tree_spans")))(_connectivities)
# a dominator is a vertex without which v can't be reached: walks that avoid each vertex in turn
_DOM = "rt AS (SELECT min(src) AS r FROM e), rc AS (SELECT r AS v FROM rt UNION SELECT e.dst FROM rc JOIN e ON e.src = rc.v), ra AS (SELECT x.v AS gone, r AS v FROM rc x, rt WHERE x.v <> r UNION SELECT ra.gone, e.dst FROM ra JOIN e ON e.src = ra.v WHERE e.dst <> ra.gone), dm AS (SELECT x.v AS dom, y.v AS v FROM rc x JOIN rc y ON x.v <> y.v WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.gone = x.v AND ra.v = y.v) UNION SELECT r, v FROM rc, rt WHERE v <> r)"
register("dominator_tree", f"WITH RECURSIVE {_DT}, {_DOM} SELECT y.v, (SELECT dom FROM dm a WHERE a.v = y.v AND NOT EXISTS (SELECT 1 FROM dm z JOIN dm a2 ON a2.v = y.v AND a2.dom = z.v WHERE z.dom = a.dom)) AS dominator FROM rc y")(
    lambda s, p: flows.dominator_tree(g := strong_trade(s, p), g.edges.agg(F.min("src")).first()[0])
)
register("edgelist_percolation", f"WITH RECURSIVE {PARTNERS}, o AS (SELECT *, row_number() OVER (ORDER BY eid) - 1 AS i FROM e), rr AS (SELECT k.i, v, v AS c FROM o k, (SELECT src AS v, i AS j FROM o UNION ALL SELECT dst, i FROM o) z WHERE z.j <= k.i GROUP BY ALL UNION SELECT rr.i, x.u, rr.c FROM rr JOIN (SELECT src AS v, dst AS u, i AS j FROM o UNION ALL SELECT dst, src, i FROM o) x ON x.v = rr.v AND x.j <= rr.i), cc AS (SELECT i, v, min(c) AS c FROM rr GROUP BY 1, 2) SELECT i, max(k) AS giant, CAST(sum(k) AS BIGINT) AS vertices FROM (SELECT i, c, count(*) AS k FROM cc GROUP BY 1, 2) GROUP BY i")(
    lambda s, p: flows.percolation(g := partners(s, p), _ordered(g))
)


def _ordered(g: Graph) -> DataFrame:
    from lattica.operators.layout import numbered

    return numbered(g.edges.select(F.col("eid").alias("v"))).withColumnRenamed("v", "eid")


register("random_spanning_tree", f"WITH {PARTNERS} SELECT count(*) - 1 AS edges FROM vs")(lambda s, p: flows.random_spanning_tree(partners(s, p), 3).agg(F.count_distinct("eid").alias("edges")))
register("feedback_arc_set", "SELECT true AS acyclic")(lambda s, p: _acyclic(strong_trade(s, p)))
register("sir", None)(lambda s, p: flows.sir(partners(s, p), 0.4, 1.0, 3, 7))
register("find_cycle", None)(lambda s, p: flows.find_cycle(strong_trade(s, p)).select("component", F.array_join(F.transform("cycle", lambda v: v.cast("string")), ",").alias("cycle")))


def _acyclic(g: Graph) -> DataFrame:
    from lattica.operators.iterate import is_dag

    rest = g.edges.join(flows.feedback_arc_set(g), "eid", "left_anti")
    return g.spark.createDataFrame([(is_dag(Graph(g.vertices, store(rest), True)),)], "acyclic boolean")
