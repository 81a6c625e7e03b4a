"""Registered queries of graph classes, with SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalogue import BOTH, DEG, TREE, register, tree
from lattica.catalogue_centrality import STEPS_BY, _DT, strong_trade
from lattica.catalogue_patterns import count_sql
from lattica.catalogue_profiles import _COMP, _N, PARTNERS, partners
from lattica.operators import classes

_ALL = "FROM s1, s2, co"
_FOREST = f"(SELECT m = n - c {_ALL})"
# 2-colouring by parity of walks: a vertex with walks of both parities from its component's least vertex is on an odd cycle
_SIDES = "pw AS (SELECT c AS v, c, 0 AS p FROM (SELECT DISTINCT c FROM cp) UNION SELECT b.u, pw.c, 1 - pw.p FROM pw JOIN b ON b.v = pw.v), ps AS (SELECT v, min(p) AS side, count(*) AS k FROM pw GROUP BY v), sd AS (SELECT side, count(*) AS k, min(d) AS low, max(d) AS high FROM ps JOIN d ON d.v = ps.v GROUP BY side)"
_TWO = "(SELECT max(k) = 1 FROM ps)"
_LEAVES = "i1 AS (SELECT v FROM d WHERE d > 1), d1 AS (SELECT i1.v, (SELECT count(*) FROM b WHERE b.v = i1.v AND b.u IN (SELECT v FROM i1)) AS d FROM i1), i2 AS (SELECT v FROM d1 WHERE d > 1), d2 AS (SELECT i2.v, (SELECT count(*) FROM b WHERE b.v = i2.v AND b.u IN (SELECT v FROM i2)) AS d FROM i2)"
_SORTED = "ds AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS i FROM d), sm AS (SELECT max(i) AS m FROM ds WHERE d >= i - 1)"
_2K2 = "(SELECT count(*) FROM e x JOIN e y ON (x.src, x.dst) < (y.src, y.dst) AND x.src NOT IN (y.src, y.dst) AND x.dst NOT IN (y.src, y.dst) AND NOT EXISTS (SELECT 1 FROM b WHERE b.v IN (x.src, x.dst) AND b.u IN (y.src, y.dst)))"
_CLASSES = {
    "is_split_graph": "(SELECT sum(CASE WHEN i <= m THEN d ELSE -d END) = max(m * (m - 1)) FROM ds, sm)", "is_threshold_graph": f"({_2K2} + {count_sql('p4')} + {count_sql('c4')} = 0)", "is_spider": f"{_FOREST} AND (SELECT c = 1 {_ALL}) AND (SELECT count(*) <= 1 FROM d WHERE d >= 3)",
    "is_caterpillar": f"{_FOREST} AND (SELECT c = 1 {_ALL}) AND (SELECT coalesce(max(d), 0) <= 2 FROM d1)", "is_lobster": f"{_FOREST} AND (SELECT c = 1 {_ALL}) AND (SELECT coalesce(max(d), 0) <= 2 FROM d2)",
    "is_pseudo_forest": "(SELECT count(*) = 0 FROM (SELECT c, count(*) AS n, (SELECT count(*) FROM e JOIN cp y ON y.v = e.src WHERE y.c = cp.c) AS m FROM cp GROUP BY c) WHERE m > n)",
    "is_wheel": f"(SELECT n >= 4 AND m = 2 * (n - 1) AND (SELECT count(*) FROM d WHERE d = n - 1) >= 1 AND (SELECT count(*) FROM d WHERE d <> 3 AND d <> n - 1) = 0 AND c = 1 {_ALL})", "is_biregular": f"{_TWO} AND (SELECT bool_and(low = high) FROM sd)",
    "is_complete_bipartite": f"{_TWO} AND (SELECT c = 1 AND m = (SELECT product(k) FROM sd) {_ALL})", "is_biclique": f"{_TWO} AND (SELECT c = 1 AND m = (SELECT product(k) FROM sd) {_ALL})", "is_acyclic": _FOREST, "satisfies_dirac": "(SELECT 2 * bottom >= n FROM s1)",
    "satisfies_ore": "(SELECT count(*) = 0 FROM d x JOIN d y ON x.v < y.v WHERE x.d + y.d < (SELECT n FROM s1) AND NOT EXISTS (SELECT 1 FROM b WHERE b.v = x.v AND b.u = y.v))",
    "is_graphical": "(SELECT bool_and((SELECT sum(d) FROM ds x WHERE x.i <= k.i) <= k.i * (k.i - 1) + coalesce((SELECT sum(least(x.d, k.i)) FROM ds x WHERE x.i > k.i), 0)) FROM ds k)", "is_regular_graph": "(SELECT top = bottom FROM s1)",
}
for _end, _graph, _sql in (("", partners, PARTNERS), ("_tree", tree, TREE)):
    register(f"undirected_classes{_end}", f"WITH RECURSIVE {_sql}, {DEG}, {_COMP}, {_N}, {_SIDES}, {_LEAVES}, {_SORTED} " + " UNION ALL ".join(f"SELECT '{n}' AS name, ({x}) AS value" for n, x in _CLASSES.items()))(lambda s, p, g=_graph: classes.undirected_classes(g(s, p)))
_ARCS = "ar AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), pr AS (SELECT least(src, dst) AS a, greatest(src, dst) AS c, count(*) AS k FROM ar GROUP BY 1, 2), tn AS (SELECT (SELECT count(*) FROM pr) = count(*) * (count(*) - 1) // 2 AS every, (SELECT count(*) FROM pr WHERE k = 2) AS two FROM vs)"
register("directed_classes", f"WITH {_DT}, {_ARCS} SELECT 'is_tournament' AS name, every AND two = 0 AS value, 0::BIGINT AS mutual FROM tn UNION ALL SELECT 'is_semicomplete', every, 0 FROM tn UNION ALL SELECT 'has_mutual', two > 0, two FROM tn")(lambda s, p: classes.directed_classes(strong_trade(s, p)))
register("is_geodetic", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {STEPS_BY} SELECT max(k) = 1 AS value FROM sg")(lambda s, p: s.createDataFrame([(classes.is_geodetic(partners(s, p)),)], "value boolean"))
register("strongly_regular_parameters", f"WITH {PARTNERS}, {DEG} SELECT 0::BIGINT AS n, 0::BIGINT AS k, 0::BIGINT AS lambda, 0::BIGINT AS mu WHERE (SELECT count(DISTINCT d) FROM d) = 1")(lambda s, p: classes.strongly_regular_parameters(partners(s, p)))
# an edge is a bridge if its ends are apart without it: walks that avoid it
_CUTS = (
    "av AS (SELECT eid, src AS v FROM e UNION SELECT av.eid, x.u FROM av JOIN (SELECT src AS v, dst AS u, eid FROM e UNION ALL SELECT dst, src, eid FROM e) x ON x.v = av.v AND x.eid <> av.eid), br AS (SELECT e.eid, e.dst NOT IN (SELECT v FROM av WHERE av.eid = e.eid) AS bridge FROM e), "
    "aw AS (SELECT x.v AS gone, (SELECT min(v) FROM vs WHERE v <> x.v) AS v FROM vs x UNION SELECT aw.gone, b.u FROM aw JOIN b ON b.v = aw.v AND b.u <> aw.gone), ac AS (SELECT gone, count(*) AS k FROM aw GROUP BY gone)"
)
_BLOCKS = {"bridge_ratio": "(SELECT avg(CASE WHEN bridge THEN 1.0 ELSE 0 END) FROM br)", "bridge_edge_ratio": "(SELECT avg(CASE WHEN bridge THEN 1.0 ELSE 0 END) FROM br)", "articulation_ratio": "(SELECT avg(CASE WHEN k < (SELECT count(*) - 1 FROM vs) THEN 1.0 ELSE 0 END) FROM ac)"}
register("block_classes", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_CUTS} " + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST(CAST({x} AS FLOAT) AS DOUBLE) AS value" for n, x in _BLOCKS.items()))(lambda s, p: classes.block_classes(partners(s, p)).where(F.col("name").isin(*_BLOCKS)).select("name", "value"))
for _name, _method in (("block_classes_whole", classes.block_classes), ("apex_classes", classes.apex_classes), ("width_bounds", classes.width_bounds), ("elimination_ordering", classes.elimination_ordering)):
    register(_name, None)(lambda s, p, f=_method: f(partners(s, p)))
