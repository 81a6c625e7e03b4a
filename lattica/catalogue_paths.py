"""Registered queries of traversals and paths, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalogue import BOTH, f32, register
from lattica.catalogue_centrality import BW, STEPS_BY, WEIGHTS_BY, WP, strong_trade
from lattica.catalogue_profiles import AP, PARTNERS, partners
from lattica.graph import store
from lattica.operators import centrality, paths

_low = lambda g, k=3: g.vertices.where(F.col("v") < k)

register("bfs", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT s, t AS v, dist, (SELECT min(b.v) FROM b JOIN ap y ON y.t = b.v WHERE y.s = ap.s AND b.u = ap.t AND y.dist + 1 = ap.dist) AS parent FROM ap WHERE s < 3")(lambda s, p: paths.bfs(g := partners(s, p), _low(g)))
register("dijkstra_tree", f"WITH {PARTNERS}, {WP} SELECT s, t AS v, dist, (SELECT min(bw.v) FROM bw JOIN wp y ON y.t = bw.v WHERE y.s = wp.s AND bw.u = wp.t AND y.dist + bw.w = wp.dist) AS parent FROM wp WHERE s < 3")(
    lambda s, p: paths.shortest_path_tree(g := partners(s, p), store(centrality.path_table(g, _low(g), "weight")), "weight")
)
# a path from the source is rebuilt by going back along least parents
_BACK = "ba AS (SELECT s, v AS t, dist, [v] AS path, parent AS next FROM tr UNION ALL SELECT ba.s, ba.t, ba.dist, list_concat([ba.next], ba.path), tr.parent FROM ba JOIN tr ON tr.s = ba.s AND tr.v = ba.next WHERE ba.next IS NOT NULL) SELECT s, t, dist, array_to_string(path, ',') AS path FROM ba WHERE next IS NULL"
_text = lambda df: df.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ","))
register("shortest_paths", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP}, tr AS MATERIALIZED (SELECT s, t AS v, dist, (SELECT min(b.v) FROM b JOIN ap y ON y.t = b.v WHERE y.s = ap.s AND b.u = ap.t AND y.dist + 1 = ap.dist) AS parent FROM ap WHERE s < 3), {_BACK}")(lambda s, p: _text(paths.shortest_paths(g := partners(s, p), _low(g))))
register("shortest_paths_weighted", f"WITH RECURSIVE {PARTNERS}, {WP}, tr AS MATERIALIZED (SELECT s, t AS v, dist, (SELECT min(bw.v) FROM bw JOIN wp y ON y.t = bw.v WHERE y.s = wp.s AND bw.u = wp.t AND y.dist + bw.w = wp.dist) AS parent FROM wp WHERE s < 3), {_BACK}")(
    lambda s, p: _text(paths.shortest_paths(g := partners(s, p), _low(g), None, "weight"))
)
_FORTH = "fo AS (SELECT s, s AS hd, 0.0::DOUBLE AS lng, [s] AS path FROM (SELECT v AS s FROM vs WHERE v < 3) UNION ALL SELECT fo.s, st.u, fo.lng + st.w, list_append(fo.path, st.u) FROM fo JOIN {0} st ON st.v = fo.hd JOIN {1} d ON d.s = fo.s AND d.t = st.u WHERE fo.lng + st.w = d.dist) SELECT s, hd AS t, lng AS dist, array_to_string(path, ',') AS path FROM fo"
register("all_shortest_paths", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {STEPS_BY}, {_FORTH.format('b1', 'ap')}")(lambda s, p: _text(paths.all_shortest_paths(g := partners(s, p), _low(g), g.vertices)))
register("all_shortest_paths_weighted", f"WITH RECURSIVE {PARTNERS}, {WEIGHTS_BY}, {_FORTH.format('bw', 'wp')}")(lambda s, p: _text(paths.all_shortest_paths(g := partners(s, p), _low(g), g.vertices, "weight")))
_SIMPLE = "si AS (SELECT v AS s, v AS hd, 0.0::DOUBLE AS lng, [v] AS path FROM vs WHERE v < 3 UNION ALL SELECT si.s, bw.u, si.lng + bw.w, list_append(si.path, bw.u) FROM si JOIN bw ON bw.v = si.hd WHERE NOT list_contains(si.path, bw.u) AND len(si.path) <= {0})"
register("all_simple_paths", f"WITH RECURSIVE {PARTNERS}, {BW}, {_SIMPLE.format(3)} SELECT s, hd AS t, lng AS length, array_to_string(path, ',') AS path FROM si WHERE len(path) > 1")(lambda s, p: _text(paths.all_simple_paths(g := partners(s, p), _low(g), None, 3, "weight")))
register("neighborhoods", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT s AS v, t AS u, CAST(dist AS BIGINT) AS dist FROM ap WHERE dist BETWEEN 1 AND 2")(lambda s, p: paths.neighborhoods(partners(s, p), 2, 1))
register("neighborhood_sizes", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT s AS v, count(*) AS size FROM ap WHERE dist <= 2 GROUP BY s")(lambda s, p: paths.neighborhoods(partners(s, p), 2).groupBy("v").agg(F.count("*").alias("size")))
register("neighborhood_graphs", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT x.s AS v, eid, src, dst FROM e JOIN ap x ON x.t = src AND x.dist <= 1 JOIN ap y ON y.s = x.s AND y.t = dst AND y.dist <= 1")(lambda s, p: paths.neighborhood_graphs(partners(s, p), 1))
for _k in (1, 2):
    register(f"local_scan_{_k}_weighted", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT x.s AS v, {f32('sum(weight)')} AS scan FROM e JOIN ap x ON x.t = src AND x.dist <= {_k} JOIN ap y ON y.s = x.s AND y.t = dst AND y.dist <= {_k} GROUP BY 1")(lambda s, p, k=_k: paths.local_scan_k(partners(s, p), k, "weight"))
register("connect_neighborhood", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} SELECT s AS src, t AS dst FROM ap WHERE s < t AND dist BETWEEN 1 AND 2")(lambda s, p: paths.connect_neighborhood(partners(s, p), 2).edges.select("src", "dst"))
register("voronoi", f"WITH {PARTNERS}, {WP} SELECT t AS v, arg_min(s, dist * 1000 + s) AS cell, min(dist) AS dist FROM wp WHERE s < 6 GROUP BY t")(lambda s, p: paths.voronoi(g := partners(s, p), _low(g, 6), "weight"))
register("eccentricities_weighted", f"WITH {PARTNERS}, {WP} SELECT s AS v, max(dist) AS eccentricity FROM wp GROUP BY s")(lambda s, p: paths.eccentricities(partners(s, p), "weight"))
register("even_tarjan_reduction", f"WITH {PARTNERS} SELECT 2 * v AS src, 2 * v + 1 AS dst, 1.0::DOUBLE AS capacity FROM vs UNION ALL SELECT 2 * src + 1, 2 * dst, (SELECT count(*) FROM vs) FROM e UNION ALL SELECT 2 * dst + 1, 2 * src, (SELECT count(*) FROM vs) FROM e")(lambda s, p: paths.even_tarjan_reduction(partners(s, p)).edges.select("src", "dst", "capacity"))
register("k_shortest_paths", None)(lambda s, p: _text(paths.k_shortest_paths(g := partners(s, p), *g.vertices.agg(F.min("v"), F.max("v")).first(), 5, "weight")))
register("fundamental_cycles", None)(lambda s, p: paths.fundamental_cycles(partners(s, p)))
register("subcomponent", None)(lambda s, p: paths.subcomponent(strong_trade(s, p), 1))
