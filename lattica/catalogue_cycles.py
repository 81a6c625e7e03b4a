"""Registered queries of fixed points, cut points, cliques and facts on graphs with cycles, hubs and triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.catalogue import BOTH, COPURCHASE, DEG, copurchase, register
from lattica.catalogue_classes import _CUTS
from lattica.catalogue_profiles import _COMP, _N, PARTNERS, partners
from lattica.graph import store
from lattica.operators import iterate, kernels, recognise, triangles

register("connected_components_copurchase", f"WITH RECURSIVE {COPURCHASE}, {BOTH}, {_COMP} SELECT v, c AS component FROM cp")(lambda s, p: iterate.connected_components(copurchase(s, p)))
# trussness by repeated h-indices over the triangles of an edge, which settle on it from above
_TRI = "t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst), te AS MATERIALIZED (SELECT a * 100 + b AS e, b * 100 + c AS f, a * 100 + c AS g FROM t UNION ALL SELECT b * 100 + c, a * 100 + b, a * 100 + c FROM t UNION ALL SELECT a * 100 + c, a * 100 + b, b * 100 + c FROM t)"
_TR = "q0 AS (SELECT eid AS e, (SELECT count(*) FROM te WHERE te.e = eid) AS x FROM e)" + "".join(
    f", q{i} AS MATERIALIZED (SELECT q.e, coalesce(max(least(m, r)), 0) AS x FROM q{i - 1} q LEFT JOIN (SELECT te.e, least(f.x, g.x) AS m, row_number() OVER (PARTITION BY te.e ORDER BY least(f.x, g.x) DESC) AS r FROM te JOIN q{i - 1} f ON f.e = te.f JOIN q{i - 1} g ON g.e = te.g) z ON z.e = q.e GROUP BY q.e)"
    for i in range(1, 16)
)
register("trussness_partners", f"WITH {PARTNERS}, {_TRI}, {_TR} SELECT e // 100 AS a, e % 100 AS b, CAST(x + 2 AS BIGINT) AS truss FROM q15")(lambda s, p: iterate.trussness(partners(s, p)))
register("spanning_forest_partners", f"WITH RECURSIVE {PARTNERS}, lr AS (SELECT eid, weight AS w, src AS v FROM e UNION SELECT lr.eid, lr.w, x.u FROM lr JOIN (SELECT src AS v, dst AS u, weight, eid FROM e UNION ALL SELECT dst, src, weight, eid FROM e) x ON x.v = lr.v AND (x.weight, x.eid) < (lr.w, lr.eid)) SELECT eid FROM e WHERE dst NOT IN (SELECT v FROM lr WHERE lr.eid = e.eid)")(
    lambda s, p: iterate.minimum_spanning_forest(partners(s, p))
)
register("cut_points_partners", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_CUTS} SELECT 'articulation' AS kind, gone AS id FROM ac WHERE k < (SELECT count(*) - 1 FROM vs) UNION ALL SELECT 'bridge', eid FROM br WHERE bridge")(lambda s, p: kernels.cut_points(partners(s, p)).where("kind != 'edge'").select("kind", "id"))
_WL = "k0 AS (SELECT v, d AS c FROM d)" + "".join(f", k{i} AS MATERIALIZED (SELECT v, dense_rank() OVER (ORDER BY c, l) AS c FROM (SELECT k.v, k.c, (SELECT list_sort(list(z.c)) FROM b JOIN k{i - 1} z ON z.v = b.u WHERE b.v = k.v) AS l FROM k{i - 1} k))" for i in range(1, 4))
register("wl_classes_partners", f"WITH {PARTNERS}, {DEG}, {_WL} SELECT min(v) AS first, count(*) AS size FROM k3 GROUP BY c")(lambda s, p: iterate.wl_colours(partners(s, p), 3).groupBy("colour").agg(F.min("v").alias("first"), F.count("*").alias("size")).select("first", "size"))
_FACTS = {
    "is_connected": "c = 1", "is_simple": "loops = 0 AND pairs = m", "has_loop": "loops > 0", "has_multiple": "pairs < m", "is_tree": "c = 1 AND m = n - 1", "is_forest": "m = n - c", "is_regular": "bottom = top", "is_complete": "loops = 0 AND pairs = n * (n - 1) / 2",
    "is_eulerian_path": "c = 1 AND odd <= 2", "is_eulerian_cycle": "c = 1 AND odd = 0", "is_empty_graph": "m = 0", "is_path": "c = 1 AND m = n - 1 AND top <= 2", "is_star": "c = 1 AND m = n - 1 AND top = n - 1", "is_unicyclic": "c = 1 AND m = n", "is_cubic": "bottom = 3 AND top = 3", "is_subcubic": "top <= 3",
}
for _end, _graph, _sql in (("partners", partners, PARTNERS), ("copurchase", copurchase, COPURCHASE)):
    register(f"facts_{_end}", f"WITH RECURSIVE {_sql}, {DEG}, {_COMP}, {_N}, od AS (SELECT count(*) AS odd FROM d WHERE d % 2 = 1) " + " UNION ALL ".join(f"SELECT '{n}' AS name, {x} AS value FROM s1, s2, co, od" for n, x in _FACTS.items()))(lambda s, p, g=_graph: recognise.facts(g(s, p)).where(F.col("name").isin(*_FACTS)))
    register(f"frustration_{_end}", f"WITH RECURSIVE {_sql}, {BOTH}, {_COMP}, l1 AS (SELECT DISTINCT c FROM cp), wk AS (SELECT c AS v, 0 AS dist, 0 AS i FROM l1 UNION SELECT b.u, wk.dist + 1, wk.i + 1 FROM wk JOIN b ON b.v = wk.v WHERE wk.i < 8), sd AS (SELECT v, min(dist) % 2 AS side FROM wk GROUP BY v), sz AS (SELECT (SELECT count(*) FROM sd WHERE side = 0) AS a, (SELECT count(*) FROM sd WHERE side = 1) AS b) SELECT 'bipartivity_index' AS name, CAST(CAST(greatest(a, b) / (a + b) AS FLOAT) AS DOUBLE) AS value FROM sz UNION ALL SELECT 'frustration_ratio', CAST(CAST((SELECT avg(CASE WHEN x.side = y.side THEN 1.0 ELSE 0 END) FROM e JOIN sd x ON x.v = src JOIN sd y ON y.v = dst) AS FLOAT) AS DOUBLE)")(
        lambda s, p, g=_graph: frustration(g(s, p))
    )


def frustration(g) -> DataFrame:
    """(name, value): the share of vertices on the larger side of a breadth-first two-colouring, and of edges within a side."""
    sides = store(recognise.bipartite_sides(g))
    one = sides.groupBy("side").agg(F.count("*").alias("k")).agg((F.max("k") / F.sum("k")).alias("value")).select(F.lit("bipartivity_index").alias("name"), "value")
    m = g.edges.count()
    two = recognise.frustrated_edges(g, sides).agg((F.count("*") / max(1, m)).alias("value")).select(F.lit("frustration_ratio").alias("name"), "value")
    return one.unionByName(two)


# all cliques, grown vertex by vertex, less those that some vertex extends
register("maximal_cliques_partners", f"WITH RECURSIVE {PARTNERS}, {BOTH}, nb AS (SELECT v, list(u) AS l FROM b GROUP BY v), gq AS (SELECT CAST([v] AS BIGINT[]) AS q FROM vs UNION ALL SELECT list_append(gq.q, x.v) FROM gq JOIN nb x ON x.v > gq.q[len(gq.q)] AND list_has_all(x.l, gq.q)) SELECT array_to_string(q, ',') AS clique FROM gq WHERE NOT EXISTS (SELECT 1 FROM nb x WHERE list_has_all(x.l, gq.q))")(
    lambda s, p: kernels.maximal_cliques(partners(s, p)).select(F.array_join(F.transform("clique", lambda v: v.cast("string")), ",").alias("clique"))
)
register("girth_partners", f"WITH {PARTNERS}, {BOTH} SELECT CASE WHEN EXISTS (SELECT 1 FROM b x JOIN b y ON x.u = y.v JOIN b z ON z.v = y.u AND z.u = x.v) THEN 3::BIGINT END AS girth")(lambda s, p: kernels.girth(partners(s, p)).agg(F.min("girth").cast("long").alias("girth")))
register("triangles_partners", f"WITH {PARTNERS} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst")(lambda s, p: triangles.list_triangles(partners(s, p)))
