"""Registered queries of layouts, spatial graphs, samplers and random models; random ones give invariants, which SQL states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalogue import f32, register, table
from lattica.catalogue_profiles import PARTNERS, partners
from lattica.graph import Graph
from lattica.operators import iterate, layout, spatial
from lattica.plans import random_models, samplers

_I = "o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, (SELECT count(*) FROM vs) AS n FROM vs)"
register("layout_circle", f"WITH {PARTNERS}, {_I} SELECT v, {f32('cos(i * (2 * pi() / n))')} AS x, {f32('sin(i * (2 * pi() / n))')} AS y FROM o")(lambda s, p: layout.layout_circle(partners(s, p)))
register("layout_grid", f"WITH {PARTNERS}, {_I} SELECT v, CAST(i % CAST(ceil(sqrt(n)) AS BIGINT) AS DOUBLE) AS x, CAST(i // CAST(ceil(sqrt(n)) AS BIGINT) AS DOUBLE) AS y FROM o")(lambda s, p: layout.layout_grid(partners(s, p)))
register("layout_grid_3d", f"WITH {PARTNERS}, {_I} SELECT v, CAST(i % 2 AS DOUBLE) AS x, CAST((i // 2) % 3 AS DOUBLE) AS y, CAST(i // 6 AS DOUBLE) AS z FROM o")(lambda s, p: layout.layout_grid_3d(partners(s, p), 2, 3))
register("layout_sphere", f"WITH {PARTNERS}, {_I}, z AS (SELECT *, -1 + 2.0 * i / (n - 1) AS z FROM o), r AS (SELECT *, sqrt(greatest(0, 1 - z * z)) AS r, CASE WHEN i > 0 AND i < n - 1 THEN 3.6 / sqrt(n) / sqrt(1 - z * z) ELSE 0 END AS turn FROM z), a AS (SELECT *, CASE WHEN i = 0 OR i = n - 1 THEN 0 ELSE sum(turn) OVER (ORDER BY i) END AS a FROM r) SELECT v, {f32('r * cos(a)')} AS x, {f32('r * sin(a)')} AS y, {f32('z')} AS z FROM a")(
    lambda s, p: layout.layout_sphere(partners(s, p))
)
register("layout_star", f"WITH {PARTNERS}, c AS (SELECT min(v) AS c FROM vs), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, (SELECT count(*) - 1 FROM vs) AS n FROM vs, c WHERE v <> c) SELECT v, {f32('cos(i * (2 * pi() / n))')} AS x, {f32('sin(i * (2 * pi() / n))')} AS y FROM o UNION ALL SELECT c, 0, 0 FROM c")(
    lambda s, p: layout.layout_star(g := partners(s, p), g.vertices.agg(F.min("v")).first()[0])
)
for _name, _method, _options in (("layout_random", layout.layout_random, {}), ("layout_random_3d", layout.layout_random, {"dims": 3}), ("layout_mds", layout.layout_mds, {}), ("layout_fruchterman_reingold", layout.layout_fruchterman_reingold, {}), ("layout_fruchterman_reingold_3d", layout.layout_fruchterman_reingold, {"dims": 3}), ("layout_kamada_kawai", layout.layout_kamada_kawai, {}), ("layout_kamada_kawai_3d", layout.layout_kamada_kawai, {"dims": 3})):
    register(_name, None)(lambda s, p, f=_method, o=_options: f(partners(s, p), **o))

# Nations as points: their customers' mean balance and their number of customers.
_POINTS = "pt AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS v, CAST(count(*) AS DOUBLE) AS x, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) % 1000 AS DOUBLE) / 10 AS y FROM customer GROUP BY 1), pp AS (SELECT p.v AS src, q.v AS dst, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy, power(p.x - q.x, 2) + power(p.y - q.y, 2) AS pq FROM pt p JOIN pt q ON p.v < q.v)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each nation with customers: how many, and the last digits of the sum of their balances."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("v")).agg(F.count("*").cast("double").alias("a"), (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")) % 1000).cast("double").alias("b"))
    return c.select("v", F.array("a", F.col("b") / 10).alias("x"))


def _kept(inside: str) -> str:
    return f"SELECT src, dst FROM pp WHERE NOT EXISTS (SELECT 1 FROM pt r WHERE r.v <> src AND r.v <> dst AND {inside})"


_PR, _QR = "(power(r.x - px, 2) + power(r.y - py, 2))", "(power(r.x - qx, 2) + power(r.y - qy, 2))"
register("gabriel_graph", f"WITH {_POINTS} " + _kept(f"{_PR} + {_QR} < pq * (1 - 1e-12)"))(lambda s, p: spatial.gabriel_graph(points(s, p)).edges.select("src", "dst"))
register("relative_neighborhood_graph", f"WITH {_POINTS} " + _kept(f"greatest({_PR}, {_QR}) < pq * (1 - 1e-12)"))(lambda s, p: spatial.relative_neighborhood_graph(points(s, p)).edges.select("src", "dst"))
_ball = lambda a, b: f"(power(r.x - ({a}x * 0.25 + {b}x * 0.75), 2) + power(r.y - ({a}y * 0.25 + {b}y * 0.75), 2))"
register("lune_beta_skeleton", f"WITH {_POINTS} " + _kept(f"greatest({_ball('p', 'q')}, {_ball('q', 'p')}) < pq * 0.5625 * (1 - 1e-12)"))(lambda s, p: spatial.lune_beta_skeleton(points(s, p), 1.5).edges.select("src", "dst"))
register("circle_beta_skeleton", f"WITH {_POINTS} " + _kept(f"{_PR} > 0 AND {_QR} > 0 AND acos(greatest(-1, least(1, ({_PR} + {_QR} - pq) / (2 * sqrt({_PR} * {_QR}))))) > asin(1 / 1.2) + 1e-12"))(lambda s, p: spatial.circle_beta_skeleton(points(s, p), 1.2).edges.select("src", "dst"))
register("beta_weighted_gabriel_graph", f"WITH {_POINTS}, gg AS ({_kept(f'{_PR} + {_QR} < pq * (1 - 1e-12)')}), w AS (SELECT src, dst, {_PR} AS pr, {_QR} AS qr, ({_PR} + pq - {_QR}) / 2 AS along, pq FROM pp JOIN gg USING (src, dst) JOIN pt r ON r.v <> src AND r.v <> dst) SELECT src, dst, {f32('min(CASE WHEN along > 0 AND pq > along THEN greatest(pr / along, qr / (pq - along)) END)')} AS beta FROM w GROUP BY 1, 2")(
    lambda s, p: spatial.beta_weighted_gabriel_graph(points(s, p))
)
register("nearest_neighbors", f"WITH {_POINTS}, n AS (SELECT p.v, q.v AS u, sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) AS length FROM pt p JOIN pt q ON p.v <> q.v) SELECT v, u, row_number() OVER (PARTITION BY v ORDER BY length, u) AS rank, {f32('length')} AS length FROM n QUALIFY rank <= 3")(lambda s, p: spatial.nearest_neighbors(points(s, p), 3))
register("spatial_edge_lengths", f"WITH {PARTNERS}, {_POINTS} SELECT eid, {f32('abs(p.x - q.x) + abs(p.y - q.y)')} AS length FROM e JOIN pt p ON p.v = src JOIN pt q ON q.v = dst")(lambda s, p: spatial.spatial_edge_lengths(partners(s, p), points(s, p), "manhattan"))
register("convex_hull_2d", f"WITH {_POINTS}, h AS (SELECT p.v FROM pt p WHERE EXISTS (SELECT 1 FROM generate_series(0, 3599) z(k) WHERE p.x * cos(k * pi() / 1800) + p.y * sin(k * pi() / 1800) >= (SELECT max(q.x * cos(k * pi() / 1800) + q.y * sin(k * pi() / 1800)) FROM pt q) - 1e-9)) SELECT v FROM h")(lambda s, p: spatial.convex_hull_2d(points(s, p)).select("v"))


def _facts(g: Graph, connected: bool = False) -> DataFrame:
    """What must hold of a random graph: its vertices, edges, loops, copies and components."""
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("copies"))
    out = e.crossJoin(g.vertices.agg(F.count("*").alias("vertices")))
    return out.crossJoin(iterate.connected_components(g).agg(F.count_distinct("component").alias("components"))) if connected else out


def _suppliers(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


_SN = "(SELECT count(*) FROM supplier)"
register("tree_game", f"SELECT {_SN} AS vertices, {_SN} - 1 AS edges, 0::BIGINT AS loops, 0::BIGINT AS copies, 1::BIGINT AS components")(lambda s, p: _facts(random_models.tree_game_prufer(s, _suppliers(s, p), 5), True))
register("bipartite_game_gnm", f"SELECT {_SN} + 40 AS vertices, 3 * {_SN} AS edges, 0::BIGINT AS loops, 0::BIGINT AS copies")(lambda s, p: _facts(random_models.bipartite_game_gnm(s, _suppliers(s, p), 40, 3 * _suppliers(s, p), 5)))
register("iea_game", f"SELECT {_SN} AS vertices, 4 * {_SN} AS edges, 0::BIGINT AS loops")(lambda s, p: _facts(random_models.iea_game(s, _suppliers(s, p), 4 * _suppliers(s, p), 5, loops=False)).drop("copies"))
register("bipartite_iea_game", f"SELECT {_SN} + 7 AS vertices, 4 * {_SN} AS edges, 0::BIGINT AS loops")(lambda s, p: _facts(random_models.bipartite_iea_game(s, _suppliers(s, p), 7, 4 * _suppliers(s, p), 5)).drop("copies"))
register("static_power_law_game", f"SELECT 50 + {_SN} AS vertices, 2 * {_SN} AS edges, 0::BIGINT AS loops, 0::BIGINT AS copies")(lambda s, p: _facts(random_models.static_power_law_game(s, 50 + _suppliers(s, p), 2 * _suppliers(s, p), 3.0, 5)))
register("sample_negative_edges", f"WITH {PARTNERS}, n AS (SELECT count(*) AS n FROM vs) SELECT (SELECT n FROM n) AS vertices, 20::BIGINT AS edges, 0::BIGINT AS loops, 0::BIGINT AS copies, 0::BIGINT AS already")(lambda s, p: _negative(partners(s, p)))
register("split_edges_connected", f"WITH {PARTNERS} SELECT (SELECT count(*) FROM vs) AS vertices, (SELECT count(*) FROM e) AS edges, 1::BIGINT AS components")(lambda s, p: _split(partners(s, p)))
register("random_sample", "SELECT 500::BIGINT AS n, 500::BIGINT AS kinds, true AS within")(lambda s, p: samplers.random_sample(s, -300, 999, 500, 3).agg(F.count("*").alias("n"), F.count_distinct("x").alias("kinds"), F.expr("min(x) >= -300 and max(x) <= 999").alias("within")))
_norm = lambda: F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x))
register("sample_sphere_surface", "SELECT 300::BIGINT AS n, 3::INTEGER AS dims, 300::BIGINT AS on_it")(lambda s, p: samplers.sample_sphere_surface(s, 3, 300, 2.0, True, 1).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.count_if((F.abs(_norm() - 2) < 1e-9) & F.forall("x", lambda x: x >= 0)).alias("on_it")))
register("sample_sphere_volume", "SELECT 300::BIGINT AS n, 300::BIGINT AS inside")(lambda s, p: samplers.sample_sphere_volume(s, 4, 300, 2.0, False, 1).agg(F.count("*").alias("n"), F.count_if(_norm() <= 2 + 1e-9).alias("inside")))
register("sample_dirichlet", "SELECT 300::BIGINT AS n, 300::BIGINT AS sound")(lambda s, p: samplers.sample_dirichlet(s, [0.5, 1.0, 3.0], 300, 1).agg(F.count("*").alias("n"), F.count_if((F.abs(F.aggregate("x", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9) & F.forall("x", lambda x: x >= 0)).alias("sound")))
for _name, _made in (
    ("bipartite_game_gnp", lambda s, n: random_models.bipartite_game_gnp(s, n, 30, 0.1, 5)), ("sbm_game", lambda s, n: random_models.sbm_game(s, [n, 20], [[0.1, 0.01], [0.01, 0.3]], 5)), ("hsbm_game", lambda s, n: random_models.hsbm_game(s, 3, 20, [10, 10], [[0.5, 0.1], [0.1, 0.5]], 0.02, 5)),
    ("islands_game", lambda s, n: random_models.islands_game(s, 3, 12, 0.4, 2, 5)), ("preference_game", lambda s, n: random_models.preference_game(s, n, [0.3, 0.7], [[0.2, 0.05], [0.05, 0.1]], 5)[0]), ("chung_lu_game", lambda s, n: random_models.chung_lu_game(s, [1.0 + v % 5 for v in range(n)], 5)),
    ("dot_product_game", lambda s, n: random_models.dot_product_game(samplers.sample_sphere_volume(s, 2, n, 1.0, True, 2).withColumnRenamed("id", "v"), 5)), ("correlated_game", lambda s, n: random_models.correlated_pair_game(s, n, 0.8, 0.1, 5)[1]),
):
    register(_name, None)(lambda s, p, f=_made: f(s, _suppliers(s, p)).edges.select("src", "dst"))


def _negative(g: Graph) -> DataFrame:
    e = random_models.sample_negative_edges(g, 20, 5)
    there = e.join(g.edges.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("already"))
    return _facts(Graph.from_edges(e, False, g.vertices)).crossJoin(there)


def _split(g: Graph) -> DataFrame:
    train, test = random_models.split_edges(g, 0.4, 5, True)
    kept = iterate.connected_components(Graph(g.vertices, train)).agg(F.count_distinct("component").alias("components"))
    return train.select("eid").unionByName(test.select("eid")).agg(F.count_distinct("eid").alias("edges")).crossJoin(g.vertices.agg(F.count("*").alias("vertices"))).crossJoin(kept)
