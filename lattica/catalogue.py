"""The registered queries of the graph operators, with their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import formulas as T
from lattica.graph import Graph, store
from lattica.operators import algebra, degree, distances, groups, iterate, kernels, recognise, sequences, triangles
from lattica.plans import constructors as made
from lattica.plans import random_graphs

SUPPLIERS, CUSTOMERS, NATIONS = 100_000_000, 200_000_000, 100


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def f32(x: str) -> str:
    """SQL: a double rounded to 24 bits, so that sums in another order compare equal."""
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def register(name: str, sql: str | None = None) -> Callable:
    """Registers a query; its doubles are rounded to 24 bits, as f32() does in SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("float").cast("double").alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        CATALOGUE[name] = Query(run, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Graphs of the tables, each as a frame and as SQL for its edges e and its vertices v.

COPURCHASE = "e AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), vs AS (SELECT DISTINCT l_partkey AS v FROM lineitem)"
ORDERS = f"e AS MATERIALIZED (SELECT l_partkey AS src, {SUPPLIERS} + l_suppkey AS dst, l_orderkey * 8 + l_linenumber AS eid, CAST(l_quantity AS DOUBLE) AS weight FROM lineitem)"
SMALL_TREE = f"e AS MATERIALIZED (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST({NATIONS} + n_nationkey AS BIGINT) AS dst FROM nation), vs AS (SELECT CAST(r_regionkey AS BIGINT) AS v FROM region UNION ALL SELECT CAST({NATIONS} + n_nationkey AS BIGINT) FROM nation)"
TREE = (
    f"e AS MATERIALIZED (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST({NATIONS} + n_nationkey AS BIGINT) AS dst FROM nation UNION ALL SELECT {NATIONS} + s_nationkey, {SUPPLIERS} + s_suppkey FROM supplier UNION ALL SELECT -1, r_regionkey FROM region), "
    "vs AS (SELECT DISTINCT v FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e))"
)
TRADE = "e AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_orderkey * 8 + l_linenumber AS eid FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), vs AS (SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation)"
BOTH = "b AS MATERIALIZED (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e)"
DEG = f"{BOTH}, d AS MATERIALIZED (SELECT vs.v, CAST(count(b.v) AS DOUBLE) AS d FROM vs LEFT JOIN b ON vs.v = b.v GROUP BY vs.v), ed AS MATERIALIZED (SELECT e.src, e.dst, x.d AS du, y.d AS dv FROM e JOIN d x ON x.v = e.src JOIN d y ON y.v = e.dst)"


def bought(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, joined for every order that has both: edges are made anew at each read, with copies and without eid."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("v"))
    orders = items.where("l_orderkey is not null").groupBy("l_orderkey").agg(F.collect_set("v").alias("vs")).where("size(vs) > 1")
    pairs = orders.select(F.explode("vs").alias("src"), "vs").select("src", F.explode("vs").alias("dst")).where("src < dst")
    return Graph(items.select("v").distinct(), pairs)


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, joined if some order has both."""
    g = bought(spark, sf_dir)
    return Graph.from_edges(store(g.edges.repartition("src").distinct().withColumn("eid", F.monotonically_increasing_id())), False, g.vertices)


def ordered(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers, an edge for each line item, weighing its quantity."""
    e = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey as long) as src", f"cast({SUPPLIERS} + l_suppkey as long) as dst", "cast(l_orderkey * 8 + l_linenumber as long) as eid", "cast(l_quantity as double) as weight")
    return Graph.from_edges(e)


def small_tree(spark: SparkSession, sf_dir: str, directed: bool = False) -> Graph:
    """Regions and their nations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    vertices = r.selectExpr("cast(r_regionkey as long) as v").unionByName(n.selectExpr(f"cast({NATIONS} + n_nationkey as long) as v"))
    return Graph.from_edges(n.selectExpr("cast(n_regionkey as long) as src", f"cast({NATIONS} + n_nationkey as long) as dst"), directed, vertices)


def tree(spark: SparkSession, sf_dir: str, directed: bool = False) -> Graph:
    """A root -1, regions, their nations, their suppliers."""
    e = table(spark, sf_dir, "nation").selectExpr("cast(n_regionkey as long) as src", f"cast({NATIONS} + n_nationkey as long) as dst")
    e = e.unionByName(table(spark, sf_dir, "supplier").selectExpr(f"cast({NATIONS} + s_nationkey as long) as src", f"cast({SUPPLIERS} + s_suppkey as long) as dst"))
    e = e.unionByName(table(spark, sf_dir, "region").selectExpr("-1L as src", "cast(r_regionkey as long) as dst"))
    return Graph.from_edges(store(e), directed)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of customers to nations of suppliers, a directed edge for each line item."""
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.selectExpr("cast(c_nationkey as long) as src", "cast(s_nationkey as long) as dst", "cast(l_orderkey * 8 + l_linenumber as long) as eid")
    return Graph.from_edges(e, True, table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as long) as v"))


def brands(spark: SparkSession, sf_dir: str, column: str = "p_brand") -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as long) as v", f"{column} as label")


def _rows(sums: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, {f32(x)} AS value FROM {source}" for n, x in sums.items())


def _case(pair: tuple[str, str], product: bool = False) -> str:
    value, rows = pair
    total = f"coalesce(sum(CASE WHEN {rows} THEN {f'ln({value})' if product else value} END), 0)"
    return f"{total}" if product else total


ON_EDGES = "(SELECT * FROM ed WHERE src <> dst)"

register("degree_sequence", f"WITH {COPURCHASE}, {DEG} SELECT v, CAST(d AS BIGINT) AS d FROM d")(lambda s, p: copurchase(s, p).degrees())
register("degree_distribution", f"WITH {COPURCHASE}, {DEG} SELECT CAST(d AS BIGINT) AS degree, count(*) AS n_vertices FROM d GROUP BY 1")(lambda s, p: degree.degree_distribution(copurchase(s, p)))
register("edge_indices", f"WITH {COPURCHASE}, {DEG} " + _rows({n: _case(x) for n, x in T.EDGE_SUMS.items() if n != "exponential_augmented_zagreb"} | {"second_zagreb_index": "sum(du * dv)"}, ON_EDGES))(
    lambda s, p: degree.edge_indices(copurchase(s, p), [n for n in [*T.EDGE_SUMS, "second_zagreb_index"] if n != "exponential_augmented_zagreb"])
)
register("edge_index_aliases", f"WITH {COPURCHASE}, {DEG} " + _rows({a: _case(T.EDGE_SUMS[n]) for a, n in T.ALIASES.items() if n in T.EDGE_SUMS}, ON_EDGES))(lambda s, p: degree.edge_indices(copurchase(s, p), [a for a, n in T.ALIASES.items() if n in T.EDGE_SUMS]))
register("edge_powers", f"WITH {COPURCHASE}, {DEG} " + _rows({n: _case((x.format(a=-0.5), r)) for n, (x, r) in T.EDGE_POWERS.items()}, ON_EDGES))(lambda s, p: degree.edge_indices(copurchase(s, p), list(T.EDGE_POWERS), a=-0.5))
register("vertex_powers", f"WITH {COPURCHASE}, {DEG} " + _rows({n: _case((x.format(a=0.5), r)) for n, (x, r) in T.VERTEX_POWERS.items()}, "d"))(lambda s, p: degree.vertex_indices(copurchase(s, p), list(T.VERTEX_POWERS), a=0.5))
PLAIN = [n for n in T.VERTEX_SUMS if n not in ("exponential_first_zagreb", "exponential_forgotten")]
register("vertex_indices", f"WITH {COPURCHASE}, {DEG} " + _rows({n: _case(T.VERTEX_SUMS[n]) for n in PLAIN}, "d"))(lambda s, p: degree.vertex_indices(copurchase(s, p), PLAIN))
register("exponential_indices", f"WITH {SMALL_TREE}, {DEG} " + _rows({n: f"ln({_case(T.VERTEX_SUMS[n])})" for n in ("exponential_first_zagreb", "exponential_forgotten")}, "d") + " UNION ALL " + _rows({"exponential_augmented_zagreb": f"ln({_case(T.EDGE_SUMS['exponential_augmented_zagreb'])})"}, ON_EDGES))(
    lambda s, p: degree.vertex_indices(g := small_tree(s, p), ["exponential_first_zagreb", "exponential_forgotten"]).unionByName(degree.edge_indices(g, ["exponential_augmented_zagreb"])).withColumn("value", F.log("value"))
)
register("edge_products", f"WITH {SMALL_TREE}, {DEG} " + _rows({n: _case(x, True) for n, x in T.EDGE_PRODUCTS.items()}, ON_EDGES) + " UNION ALL " + _rows({n: _case(x, True) for n, x in T.VERTEX_PRODUCTS.items()}, "d"))(
    lambda s, p: degree.edge_indices(g := small_tree(s, p), list(T.EDGE_PRODUCTS)).unionByName(degree.vertex_indices(g, list(T.VERTEX_PRODUCTS))).withColumn("value", F.log("value"))
)
register("edge_entropies", f"WITH {COPURCHASE}, {DEG} " + _rows({n: f"ln(sum(CASE WHEN {r} THEN {w} END)) - sum(CASE WHEN {r} THEN ({w}) * ln({w}) END) / sum(CASE WHEN {r} THEN {w} END)" for n, (w, r) in T.EDGE_ENTROPIES.items()}, ON_EDGES))(lambda s, p: degree.edge_entropies(copurchase(s, p)))
PAIRS = "pr AS (SELECT x.d AS du, y.d AS dv FROM d x JOIN d y ON x.v < y.v)"
register("coindices", f"WITH {SMALL_TREE}, {DEG}, {PAIRS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, " + f32(f"(SELECT sum({x}) FROM pr) / 2" if n == "total_irregularity" else f"(SELECT sum({x}) FROM pr) - (SELECT sum({x}) FROM {ON_EDGES})") + " AS value" for n, x in T.COINDICES.items()
))(lambda s, p: degree.coindices(small_tree(s, p)))

_S = "s AS (SELECT count(*) AS n, sum(d) AS s, avg(d) AS mean, max(d) AS top, min(d) AS bottom, sum(d * d) AS q, var_pop(d) AS var, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr FROM d)"
_K = "k AS (SELECT d, count(*) AS k FROM d GROUP BY d)"
_GINI = "gr AS (SELECT d, row_number() OVER (ORDER BY d, v) AS i FROM d)"
STATS = {
    "degree_mad": "(SELECT avg(abs(d - mean)) FROM d, s)", "degree_entropy_ln": "(SELECT -sum(k / n * ln(k / n)) FROM k, s)", "degree_entropy": "(SELECT -sum(k / n * log2(k / n)) FROM k, s)", "degree_entropy_normalized": "(SELECT -sum(k / n * ln(k / n)) / max(ln(n)) FROM k, s)",
    "degree_entropy_ratio": "(SELECT -sum(k / n * ln(k / n)) / max(ln(n)) FROM k, s)", "degree_herfindahl": "(SELECT q / (s * s) FROM s)", "degree_theil": "(SELECT sum(CASE WHEN d > 0 THEN d / mean * ln(d / mean) ELSE 0 END) / max(n) FROM d, s)",
    "degree_palma": "(SELECT sum(CASE WHEN i > n - floor(0.1 * n) THEN d ELSE 0 END) / sum(CASE WHEN i <= floor(0.4 * n) THEN d ELSE 0 END) FROM gr, s)", "degree_hoover": "(SELECT sum(abs(d - mean)) / max(2 * s.s) FROM d, s)", "degree_variance": "(SELECT var FROM s)", "degree_cv": "(SELECT sqrt(var) / mean FROM s)",
    "degree_skewness": "(SELECT avg(power((d - mean) / sqrt(var), 3)) FROM d, s)", "degree_kurtosis": "(SELECT avg(power((d - mean) / sqrt(var), 4)) - 3 FROM d, s)", "degree_gini": "(SELECT sum((2 * i - n - 1) * d) / max(n * s.s) FROM gr, s)", "degree_max_deviation": "(SELECT max(abs(d - mean)) FROM d, s)",
    "degree_mode": "(SELECT d FROM k ORDER BY k DESC, d LIMIT 1)", "degree_concentration": "(SELECT max(k) / max(n) FROM k, s)", "degree_diversity": "(SELECT count(*) FROM k)", "hub_dominance": "(SELECT top / s FROM s)", "hub_dominance_ratio": "(SELECT 2 * top / s FROM s)",
    "degree_range": "(SELECT top - bottom FROM s)", "degree_span_ratio": "(SELECT (top - bottom) / mean FROM s)", "degree_leaf_ratio": "(SELECT avg(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) FROM d)", "degree_isolated_ratio": "(SELECT avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END) FROM d)",
    "degree_core_ratio": "(SELECT avg(CASE WHEN d >= mean - 1e-12 THEN 1.0 ELSE 0 END) FROM d, s)", "degree_tail_ratio": "(SELECT avg(CASE WHEN d >= 2 * mean - 1e-12 THEN 1.0 ELSE 0 END) FROM d, s)", "hub_ratio": "(SELECT avg(CASE WHEN d > mean + 1e-15 THEN 1.0 ELSE 0 END) FROM d, s)",
    "leaf_to_hub_ratio": "(SELECT sum(CASE WHEN d = 1 THEN 1.0 ELSE 0 END) / sum(CASE WHEN d > mean + 1e-15 THEN 1.0 ELSE 0 END) FROM d, s)", "freeman_degree_centralization": "(SELECT sum(top - d) / max((n - 1) * (n - 2)) FROM d, s)", "connectivity_index": "(SELECT mean / (n - 1) FROM s)", "edge_vertex_ratio": "(SELECT s / 2 / n FROM s)",
    "degree_variance_ratio": "(SELECT var / ((n - 1) * (n - 1) / 4) FROM s)", "degree_range_ratio": "(SELECT bottom / top FROM s)", "degree_spectral_gap_estimate": "(SELECT (a - b) / a FROM (SELECT max(d) AS a, (SELECT d FROM d ORDER BY d DESC LIMIT 1 OFFSET 1) AS b FROM d))",
    "structural_information_content": "(SELECT log2(count(*)) / max(log2(n)) FROM k, s)", "walk_entropy": "(SELECT -sum(CASE WHEN d > 0 THEN d / s.s * ln(d / s.s) ELSE 0 END) FROM d, s)", "walk_regularity": "(SELECT 1 - sqrt(var) / mean FROM s)", "degree_laplacian_energy": "(SELECT sum(abs(d - mean)) / max(n * top) FROM d, s)",
    "even_odd_walk_ratio": "(SELECT q / s FROM s)", "von_neumann_entropy": "(SELECT greatest(0, 1 - 1.0 / n - q / (s * s)) FROM s)", "degree_median": "(SELECT median FROM s)", "degree_iqr": "(SELECT iqr FROM s)", "max_degree": "(SELECT top FROM s)", "min_degree": "(SELECT bottom FROM s)", "mean_degree": "(SELECT mean FROM s)", "density": "(SELECT s / 2 / n / (n - 1) * 2 FROM s)",
}
for _name, _graph, _sql in (("degree_statistics", copurchase, COPURCHASE), ("degree_statistics_tree", tree, TREE)):
    register(_name, f"WITH {_sql}, {DEG}, {_S}, {_K}, {_GINI} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {f32(x)} AS value" for n, x in STATS.items()))(lambda s, p, g=_graph: degree.degree_statistics(g(s, p)))
_M = "mo AS (SELECT avg(du) AS x, avg(dv) AS y, avg(du * dv) AS xy, avg(du * du) AS xx, avg(dv * dv) AS yy, avg(power(du - dv, 2)) AS gap, avg((du + dv) / 2) AS half, avg((du * du + dv * dv) / 2) AS sq FROM ed), dp AS (SELECT least(du, dv) AS a, greatest(du, dv) AS b, CAST(count(*) AS DOUBLE) AS k FROM ed WHERE src <> dst GROUP BY 1, 2)"
register("edge_degree_statistics", f"WITH {COPURCHASE}, {DEG}, {_M} " + _rows({
    "edge_degree_covariance": "xy - x * y", "edge_degree_pearson": "(xy - x * y) / sqrt((xx - x * x) * (yy - y * y))", "edge_degree_cosine": "xy / sqrt(xx * yy)", "edge_degree_discrepancy": "gap / 4", "edge_degree_rms": "sqrt(sq)", "assortativity_degree": "(xy - half * half) / (sq - half * half)",
}, "mo") + " UNION ALL " + _rows({"edge_degree_entropy": "-sum(k / m * ln(k / m))", "edge_weight_balance": "-sum(k / m * ln(k / m)) / ln(count(*))", "degree_pair_concentration": "max(k) / max(m)"}, "dp, (SELECT sum(k) AS m FROM dp)"))(lambda s, p: degree.edge_degree_statistics(copurchase(s, p)))

register("strength", f"WITH {ORDERS} SELECT v, {f32('sum(weight)')} AS strength FROM (SELECT src AS v, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY v")(lambda s, p: ordered(s, p).strength())
register("edge_flags", f"WITH {ORDERS} SELECT eid, src = dst AS is_loop, row_number() OVER (PARTITION BY src, dst ORDER BY eid) > 1 AS is_multiple, count(*) OVER (PARTITION BY src, dst) AS count_multiple, true AS is_mutual FROM e")(lambda s, p: algebra.edge_flags(ordered(s, p)))
register("edge_flags_directed", f"WITH {TRADE} SELECT eid, src = dst AS is_loop, row_number() OVER (PARTITION BY src, dst ORDER BY eid) > 1 AS is_multiple, count(*) OVER (PARTITION BY src, dst) AS count_multiple, EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src) AS is_mutual FROM e")(lambda s, p: algebra.edge_flags(trade(s, p)))
register("simplify", f"WITH {ORDERS} SELECT DISTINCT src, dst FROM e WHERE src <> dst")(lambda s, p: algebra.simplify(ordered(s, p)).edges.select("src", "dst"))
_C = "SELECT src, dst, count(*) AS k FROM e GROUP BY 1, 2"
for _name, _expr, _having in (("union", "k", ""), ("intersection", "least(k, 1)", ""), ("difference", "k - 1", " WHERE k > 1")):
    register(_name, f"WITH {ORDERS} SELECT src, dst, CAST({_expr} AS BIGINT) AS copies FROM ({_C}){_having}")(
        lambda s, p, f=getattr(algebra, _name): f(g := ordered(s, p), algebra.simplify(g)).edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
    )
register("disjoint_union", f"WITH {SMALL_TREE} SELECT src, dst FROM e UNION ALL SELECT src + 1000, dst + 1000 FROM e")(lambda s, p: algebra.disjoint_union(g := small_tree(s, p), g, 1000).edges.select("src", "dst"))
register("complementer", f"WITH {SMALL_TREE} SELECT x.v AS src, y.v AS dst FROM vs x JOIN vs y ON x.v < y.v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = x.v AND e.dst = y.v)")(lambda s, p: algebra.complementer(small_tree(s, p)).edges.select("src", "dst"))
register("to_undirected_mutual", f"WITH {TRADE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst AND EXISTS (SELECT 1 FROM e r WHERE r.src = e.dst AND r.dst = e.src)")(lambda s, p: algebra.to_undirected(trade(s, p), "mutual").edges.select("src", "dst"))
register("to_undirected_collapse", f"WITH {TRADE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e")(lambda s, p: algebra.to_undirected(trade(s, p)).edges.select("src", "dst"))
register("reverse", f"WITH {TRADE} SELECT dst AS src, src AS dst, count(*) AS copies FROM e GROUP BY 1, 2")(lambda s, p: algebra.reverse(trade(s, p)).edges.groupBy("src", "dst").agg(F.count("*").alias("copies")))
register("line_graph", f"WITH {TREE}, {BOTH}, i AS (SELECT v, v * 1000000000 + u AS x, least(v, u) AS a, greatest(v, u) AS c FROM b) SELECT x.a AS a1, x.c AS c1, y.a AS a2, y.c AS c2 FROM i x JOIN i y ON x.v = y.v AND (x.a, x.c) < (y.a, y.c)")(lambda s, p: _line_graph(tree(s, p)))
register("compose", f"WITH {TREE} SELECT x.src, y.dst, count(*) AS copies FROM e x JOIN e y ON x.dst = y.src GROUP BY 1, 2")(lambda s, p: algebra.compose(g := tree(s, p, True), g).edges.groupBy("src", "dst").agg(F.count("*").alias("copies")))
register("bipartite_projection", f"WITH {ORDERS}, c AS (SELECT dst AS a, src AS m, count(*) AS k FROM e GROUP BY 1, 2) SELECT x.a, y.a AS b, CAST(sum(x.k * y.k) AS BIGINT) AS multiplicity FROM c x JOIN c y ON x.m = y.m AND x.a < y.a GROUP BY 1, 2")(lambda s, p: algebra.bipartite_projection(ordered(s, p).edges, "dst", "src"))
register("contract_vertices", f"SELECT CAST(least(0, n_regionkey + 1) AS BIGINT) AS src, CAST(n_regionkey + 1 AS BIGINT) AS dst, count(*) AS copies FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")(lambda s, p: _contracted(s, p))
register("induced_subgraph", f"WITH {TREE}, big AS (SELECT src AS v FROM e GROUP BY 1) SELECT src, dst FROM e WHERE src IN (SELECT v FROM big) AND dst IN (SELECT v FROM big)")(lambda s, p: algebra.induced_subgraph(g := tree(s, p), g.edges.select(F.col("src").alias("v")).distinct()).edges.select("src", "dst"))
_P = {"cartesian": "(x1 = x2 AND abs(y1 - y2) IN (1, 3)) OR (y1 = y2 AND abs(x1 - x2) = 1)", "tensor": "abs(y1 - y2) IN (1, 3) AND abs(x1 - x2) = 1", "strong": "((x1 = x2 OR abs(x1 - x2) = 1) AND (y1 = y2 OR abs(y1 - y2) IN (1, 3)))", "lexicographic": "abs(x1 - x2) = 1 OR (x1 = x2 AND abs(y1 - y2) IN (1, 3))"}
for _kind, _rule in _P.items():
    register(f"{_kind}_product", f"WITH c AS (SELECT a.i AS x, b.i AS y FROM generate_series(0, 4) a(i), generate_series(0, 3) b(i)) SELECT p.x * 4 + p.y AS src, q.x * 4 + q.y AS dst FROM (SELECT x AS x1, y AS y1, * FROM c) p JOIN (SELECT x AS x2, y AS y2, * FROM c) q ON p.x * 4 + p.y < q.x * 4 + q.y AND ({_rule})")(
        lambda s, p, k=_kind: algebra.product(made.path_graph(s, 5), made.ring_graph(s, 4), k, 4).edges.select("src", "dst")
    )


def _line_graph(g: Graph) -> DataFrame:
    ends = store(g.edges)
    g = Graph(g.vertices, ends)
    e = algebra.line_graph(g).edges
    x = ends.select(F.col("eid").alias("src"), F.col("src").alias("a1"), F.col("dst").alias("c1"))
    y = ends.select(F.col("eid").alias("dst"), F.col("src").alias("a2"), F.col("dst").alias("c2"))
    j = e.join(x, "src").join(y, "dst")
    flip = F.struct("a1", "c1") < F.struct("a2", "c2")
    return j.select(*[F.when(flip, F.col(k)).otherwise(F.col(o)).alias(k) for k, o in (("a1", "a2"), ("c1", "c2"), ("a2", "a1"), ("c2", "c1"))])


def _lightest(g: Graph) -> Graph:
    """Of parallel edges the lightest."""
    return Graph.from_edges(store(g.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")).withColumn("eid", F.monotonically_increasing_id())), False, g.vertices)


def _contracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers to their region, nations to 0."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    e = s.selectExpr(f"cast({NATIONS} + s_nationkey as long) as src", f"cast({SUPPLIERS} + s_suppkey as long) as dst")
    mapping = s.selectExpr(f"cast({SUPPLIERS} + s_suppkey as long) as v", "cast(n_regionkey + 1 as long) as to").unionByName(n.selectExpr(f"cast({NATIONS} + n_nationkey as long) as v", "0L as to"))
    return algebra.contract_vertices(Graph.from_edges(store(e)), mapping).edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))


TRI = "t AS MATERIALIZED (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)"
PER = f"{TRI}, tv AS (SELECT v, count(*) AS k FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v), cl AS (SELECT d.v, CAST(d.d AS BIGINT) AS degree, coalesce(tv.k, 0) AS triangles, CASE WHEN d.d >= 2 THEN 2.0 * coalesce(tv.k, 0) / (d.d * (d.d - 1)) END AS transitivity FROM d LEFT JOIN tv ON d.v = tv.v)"
register("clustering", f"WITH {COPURCHASE}, {DEG}, {PER} SELECT v, degree, triangles, {f32('transitivity')} AS transitivity FROM cl")(lambda s, p: triangles.clustering(bought(s, p)))
register("triangle_totals", f"WITH {COPURCHASE}, {DEG}, {PER} " + _rows({"count_triangles": "sum(triangles) / 3.0", "transitivity_undirected": "sum(triangles) / sum(degree * (degree - 1) / 2)", "transitivity_avglocal_undirected": "avg(transitivity)", "avg_local_clustering": "avg(coalesce(transitivity, 0))"}, "cl"))(lambda s, p: triangles.triangle_totals(bought(s, p)))
register("local_scan", f"WITH {COPURCHASE}, {DEG}, {PER} SELECT v, CAST(degree + triangles AS BIGINT) AS local_scan FROM cl")(lambda s, p: triangles.local_scan(bought(s, p)))
register("edge_support", f"WITH {COPURCHASE}, {TRI}, on_ AS (SELECT a, b, count(*) AS k FROM (SELECT a, b FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT a, c FROM t) GROUP BY 1, 2) SELECT e.src AS a, e.dst AS b, coalesce(k, 0) AS support FROM e LEFT JOIN on_ ON e.src = on_.a AND e.dst = on_.b")(lambda s, p: triangles.edge_support(copurchase(s, p)))
_SIM = {
    "similarity_jaccard": "k / (x + y - k)", "similarity_dice": "2 * k / (x + y)", "similarity_inverse_log_weighted": "aa", "link_pred_common_neighbors": "k", "link_pred_adamic_adar": "aa", "link_pred_resource_allocation": "ra", "link_pred_preferential_attachment": "x * y", "link_pred_salton": "k / sqrt(x * y)",
    "link_pred_sorensen": "2 * k / (x + y)", "link_pred_hub_promoted": "k / least(x, y)", "link_pred_hub_depressed": "k / greatest(x, y)", "link_pred_leicht_holme_newman": "k / (x * y)",
}
register("similarity", f"WITH {TREE}, {DEG}, c AS (SELECT p.u AS a, q.u AS b, count(*) AS k, sum(1 / ln(d.d)) AS aa, sum(1 / d.d) AS ra FROM b p JOIN b q ON p.v = q.v AND p.u < q.u JOIN d ON d.v = p.v GROUP BY 1, 2) SELECT a, b, " + ", ".join(f"{f32(x)} AS {n}" for n, x in _SIM.items()) + " FROM (SELECT c.*, x.d AS x, y.d AS y FROM c JOIN d x ON x.v = a JOIN d y ON y.v = b)")(lambda s, p: triangles.similarity(tree(s, p)))
register("cocitation", f"WITH {TREE} SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2")(lambda s, p: triangles.cocitation(tree(s, p, True)))
register("bibcoupling", f"WITH {ORDERS} SELECT x.src AS a, y.src AS b, count(*) AS n FROM (SELECT dst AS src, src AS dst FROM e) x JOIN (SELECT dst AS src, src AS dst FROM e) y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2")(
    lambda s, p: triangles.bibcoupling(algebra.reverse(Graph.from_edges((g := ordered(s, p)).edges, True, g.vertices)))
)
_T = "p AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
register("dyad_census", f"WITH {TRADE}, {_T}, w AS (SELECT least(src, dst), greatest(src, dst), count(*) AS ways FROM p GROUP BY 1, 2) SELECT CAST(sum(CASE WHEN ways = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS mutual, CAST(sum(CASE WHEN ways = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS asymmetric, (SELECT count(*) * (count(*) - 1) / 2.0 FROM vs) - count(*) AS none FROM w")(lambda s, p: triangles.dyad_census(trade(s, p)))
register("reciprocity", f"WITH {TRADE}, k AS (SELECT src, dst, count(*) AS k FROM e WHERE src <> dst GROUP BY 1, 2) SELECT {f32('sum(least(x.k, coalesce(y.k, 0))) / sum(x.k)')} AS reciprocity FROM k x LEFT JOIN k y ON x.src = y.dst AND x.dst = y.src")(lambda s, p: triangles.reciprocity(trade(s, p)))
register("burt_constraint", f"WITH {TREE}, {DEG}, pp AS (SELECT b.v, b.u, 1 / d.d AS p FROM b JOIN d ON d.v = b.v), two AS (SELECT x.v, y.u, sum(x.p * y.p) AS p2 FROM pp x JOIN pp y ON x.u = y.v AND y.u <> x.v GROUP BY 1, 2) SELECT pp.v, {f32('sum(power(p + coalesce(p2, 0), 2))')} AS \"constraint\" FROM pp LEFT JOIN two ON pp.v = two.v AND pp.u = two.u GROUP BY 1")(lambda s, p: triangles.burt_constraint(tree(s, p)))

LAB = "l AS (SELECT p_partkey AS v, p_brand AS label FROM part)"
_PM = f"x AS (SELECT a.label AS x, b.label AS y FROM e JOIN l a ON a.v = e.src JOIN l b ON b.v = e.dst), pc AS (SELECT label AS c, sum(d) AS vol, count(*) AS size, coalesce((SELECT count(*) FROM x WHERE x.x = label AND x.y = label), 0) AS within FROM d JOIN l ON d.v = l.v GROUP BY label), cc AS (SELECT *, vol - 2 * within AS cut FROM pc)"
_PARTS = {"modularity": "sum(2.0 * within / m2 - vol * vol / (m2 * m2))", "cut_size": "max(m2) / 2 - sum(within)", "edge_homophily": "2.0 * sum(within) / max(m2)", "assortativity_nominal": "sum(2.0 * within / m2 - vol * vol / (m2 * m2)) / (1 - sum(vol * vol / (m2 * m2)))", "coverage": "2.0 * sum(within) / max(m2)", "normalized_cut": "sum(cut / vol)", "ratio_cut": "sum(cut / size)", "max_conductance": "max(cut / vol)"}
register("partition_measures", f"WITH {COPURCHASE}, {DEG}, {LAB}, {_PM} " + _rows(_PARTS, "cc, (SELECT sum(vol) AS m2 FROM cc)"))(lambda s, p: groups.partition_measures(copurchase(s, p), brands(s, p)))
register("node_homophily", f"WITH {COPURCHASE}, {BOTH}, {LAB} SELECT b.v, {f32('avg(CASE WHEN x.label = y.label THEN 1.0 ELSE 0 END)')} AS share FROM b JOIN l x ON x.v = b.v JOIN l y ON y.v = b.u GROUP BY 1")(lambda s, p: groups.node_homophily(copurchase(s, p), brands(s, p)))
register("joint_type_distribution", f"WITH {COPURCHASE}, {BOTH}, {LAB} SELECT x.label AS x, y.label AS y, count(*) AS n FROM b JOIN l x ON x.v = b.v JOIN l y ON y.v = b.u GROUP BY 1, 2")(lambda s, p: groups.joint_type_distribution(copurchase(s, p), brands(s, p)))
register("joint_degree_matrix", f"WITH {COPURCHASE}, {DEG} SELECT CAST(least(du, dv) AS BIGINT) AS du, CAST(greatest(du, dv) AS BIGINT) AS dv, count(*) AS n FROM ed GROUP BY 1, 2")(lambda s, p: groups.joint_degree_matrix(copurchase(s, p)))
register("avg_nearest_neighbor_degree", f"WITH {COPURCHASE}, {DEG} SELECT b.v, {f32('avg(d.d)')} AS knn FROM b JOIN d ON d.v = b.u GROUP BY 1")(lambda s, p: groups.avg_nearest_neighbor_degree(copurchase(s, p)))
register("knnk", f"WITH {COPURCHASE}, {DEG}, kn AS (SELECT b.v, avg(d.d) AS k FROM b JOIN d ON d.v = b.u GROUP BY 1) SELECT CAST(d.d AS BIGINT) AS degree, {f32('avg(k)')} AS knnk FROM kn JOIN d ON d.v = kn.v GROUP BY 1")(lambda s, p: groups.knnk(copurchase(s, p)))
SIG = "sg AS (SELECT p_partkey AS v, CAST(p_retailprice AS DOUBLE) AS value FROM part)"
_SG = "m AS (SELECT x.value AS x, y.value AS y FROM e JOIN sg x ON x.v = e.src JOIN sg y ON y.v = e.dst)"
_price = lambda s, p: table(s, p, "part").selectExpr("cast(p_partkey as long) as v", "cast(p_retailprice as double) as value")
register("signal_measures", f"WITH {COPURCHASE}, {SIG}, {_SG} " + _rows({"dirichlet_energy": "sum(power(x - y, 2))", "total_variation": "sum(abs(x - y))", "dirichlet_share": "sum(power(x - y, 2)) / (2 * sum(x * x + y * y))", "smoothness_ratio": "1 - sum(power(x - y, 2)) / (2 * sum(x * x + y * y))", "assortativity": "(avg(x * y) - power(avg((x + y) / 2), 2)) / (avg((x * x + y * y) / 2) - power(avg((x + y) / 2), 2))"}, "m"))(lambda s, p: groups.signal_measures(copurchase(s, p), _price(s, p)))
register("neighbor_aggregate", f"WITH {COPURCHASE}, {BOTH}, {SIG} SELECT b.v, {f32('sum(value)')} AS sum, {f32('avg(value)')} AS mean, {f32('max(value)')} AS max, {f32('min(value)')} AS min FROM b JOIN sg ON sg.v = b.u GROUP BY 1")(lambda s, p: groups.neighbor_aggregate((g := copurchase(s, p)).with_edges(g.edges), _price(s, p)).join(g.slots.select("v").distinct(), "v"))
register("symmetric_diffuse", f"WITH {COPURCHASE}, {DEG}, {SIG} SELECT b.v, {f32('sum(value / sqrt(x.d * y.d))')} AS value FROM b JOIN sg ON sg.v = b.u JOIN d x ON x.v = b.v JOIN d y ON y.v = b.u GROUP BY 1")(lambda s, p: groups.symmetric_diffuse(copurchase(s, p), _price(s, p)))
_J = "j AS (SELECT p_brand AS x, p_type AS y, CAST(count(*) AS DOUBLE) AS k FROM part GROUP BY 1, 2), r AS (SELECT x, sum(k) AS k, max(k) AS m FROM j GROUP BY 1), c AS (SELECT y, sum(k) AS k, max(k) AS m FROM j GROUP BY 1), tt AS (SELECT (SELECT sum(k) FROM j) AS n), h AS (SELECT (SELECT -sum(r.k / n * ln(r.k / n)) FROM r, tt) AS hx, (SELECT -sum(c.k / n * ln(c.k / n)) FROM c, tt) AS hy, (SELECT sum(j.k / n * ln(j.k * n / (r.k * c.k))) FROM j JOIN r ON r.x = j.x JOIN c ON c.y = j.y, tt) AS i, (SELECT sum(k * (k - 1) / 2) FROM j) AS pairs, (SELECT sum(k * (k - 1) / 2) FROM r) AS px, (SELECT sum(k * (k - 1) / 2) FROM c) AS py, (SELECT n * (n - 1) / 2 FROM tt) AS p, (SELECT 2 * n FROM tt) - (SELECT sum(m) FROM r) - (SELECT sum(m) FROM c) AS sj)"
register("compare_communities", f"WITH {_J} " + _rows({"vi": "hx + hy - 2 * i", "nmi": "2 * i / (hx + hy)", "rand": "(p + 2 * pairs - px - py) / p", "adjusted_rand": "(pairs - px * py / p) / ((px + py) / 2 - px * py / p)", "split_join": "sj"}, "h"))(lambda s, p: groups.compare_communities(brands(s, p), brands(s, p, "p_type")))

DIST = f"{BOTH}, walk(s, t, dist, via) AS (SELECT v, v, 0, CAST(-9 AS BIGINT) FROM vs UNION ALL SELECT w.s, b.u, w.dist + 1, w.t FROM walk w JOIN b ON b.v = w.t AND b.u <> w.via), ds AS MATERIALIZED (SELECT s, t, dist FROM walk)"
register("distances", f"WITH RECURSIVE {TREE}, {DIST} SELECT s, t, dist, CAST(1 AS BIGINT) AS paths FROM ds")(lambda s, p: distances.distances(tree(s, p)))
register("vertex_distances", f"WITH RECURSIVE {TREE}, {DIST} SELECT s AS v, CAST(max(dist) AS BIGINT) AS eccentricity, {f32('(count(*) - 1) * 1.0 / sum(dist)')} AS closeness, {f32('sum(CASE WHEN dist > 0 THEN 1.0 / dist ELSE 0 END)')} AS harmonic_sum, count(*) - 1 AS reachable, CAST(sum(dist) AS BIGINT) AS farness FROM ds GROUP BY s")(lambda s, p: distances.vertex_distances(*distances.class_distances(tree(s, p))[:2]))
register("path_length_hist", f"WITH RECURSIVE {TREE}, {DIST} SELECT CAST(dist AS BIGINT) AS length, count(*) AS pairs FROM ds WHERE s < t GROUP BY 1")(lambda s, p: distances.path_length_hist(distances.class_distances(tree(s, p))[0], False))
_DP = "dp AS (SELECT ds.dist, x.d AS x, y.d AS y FROM ds JOIN d x ON x.v = s JOIN d y ON y.v = t WHERE s < t), ve AS (SELECT s AS v, CAST(max(dist) AS DOUBLE) AS ecc, CAST(sum(dist) AS DOUBLE) AS far FROM ds GROUP BY 1), vd AS (SELECT ve.*, d.d FROM ve JOIN d ON d.v = ve.v), ee AS (SELECT a.ecc AS x, b.ecc AS y, a.far AS fx, b.far AS fy, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM vs) AS n FROM e JOIN ve a ON a.v = e.src JOIN ve b ON b.v = e.dst)"
_DI = {"wiener_index": "sum(dist)", "hyper_wiener_index": "sum((dist + dist * dist) / 2.0)", "harary_index": "sum(1.0 / dist)", "reciprocal_square_harary": "sum(1.0 / (dist * dist))", "schultz_index": "sum((x + y) * dist)", "gutman_index": "sum(x * y * dist)", "additively_weighted_harary": "sum((x + y) / dist)", "multiplicatively_weighted_harary": "sum(x * y / dist)", "mean_distance": "avg(dist)", "diameter": "max(dist)", "global_efficiency": "avg(1.0 / dist)"}
_DV = {"radius": "min(ecc)", "total_eccentricity": "sum(ecc)", "average_eccentricity": "avg(ecc)", "first_zagreb_eccentricity": "sum(ecc * ecc)", "connective_eccentricity_index": "sum(d / ecc)", "eccentric_connectivity_index": "sum(d * ecc)", "eccentric_distance_sum": "sum(ecc * far)", "degree_distance": "sum(d * far)"}
_DE = {"second_zagreb_eccentricity": "sum(x * y)", "fourth_abc_index": "sum(sqrt((x + y - 2) / (x * y)))", "fifth_ga_index": "sum(2 * sqrt(x * y) / (x + y))", "balaban_j_index": "sum(m / (m - n + 2.0) / sqrt(fx * fy))", "sum_balaban_index": "sum(m / (m - n + 2.0) / sqrt(fx + fy))"}
_DEG_WITHOUT_BOTH = DEG.replace(BOTH + ", ", "")
register("distance_indices", f"WITH RECURSIVE {TREE}, {DIST}, {_DEG_WITHOUT_BOTH}, {_DP} " + _rows(_DI, "dp") + " UNION ALL " + _rows(_DV, "vd") + " UNION ALL " + _rows(_DE, "ee"))(lambda s, p: distances.distance_indices(tree(s, p)))
_SZ = "sz AS (SELECT e.src, e.dst, sum(CASE WHEN a.dist < b.dist THEN 1 ELSE 0 END) AS nu, sum(CASE WHEN b.dist < a.dist THEN 1 ELSE 0 END) AS nv, (SELECT count(*) FROM vs) AS n FROM e JOIN ds a ON a.s = e.src JOIN ds b ON b.s = e.dst AND a.t = b.t GROUP BY 1, 2)"
register("szeged_indices", f"WITH RECURSIVE {TREE}, {DIST}, {_SZ} " + _rows({"szeged_index": "sum(nu * nv)", "vertex_pi_index": "sum(nu + nv)", "mostar_index": "sum(abs(nu - nv))", "revised_szeged_index": "sum((nu + (n - nu - nv) / 2.0) * (nv + (n - nu - nv) / 2.0))"}, "sz"))(lambda s, p: distances.szeged_indices(tree(s, p)))
register("betweenness", f"WITH RECURSIVE {TREE}, {DIST} SELECT vs.v, CAST(coalesce(k, 0) AS DOUBLE) / 2 AS betweenness FROM vs LEFT JOIN (SELECT a.t AS v, count(*) AS k FROM ds a JOIN ds c ON c.s = a.s JOIN ds z ON z.s = a.t AND z.t = c.t WHERE a.dist > 0 AND z.dist > 0 AND a.dist + z.dist = c.dist GROUP BY 1) q ON q.v = vs.v")(lambda s, p: distances.betweenness(tree(s, p)))
_roots = lambda s, p: s.range(1).selectExpr("-1L as v")
register("weighted_distances", f"WITH RECURSIVE {TREE}, up(t, dist) AS (SELECT CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) UNION ALL SELECT e.dst, up.dist + (e.dst % 7) + 1 FROM up JOIN e ON e.src = up.t) SELECT CAST(-1 AS BIGINT) AS s, t, dist FROM up")(lambda s, p: distances.weighted_distances((g := tree(s, p)).with_edges(g.edges.withColumn("weight", F.expr("dst % 7 + 1.0D"))), _roots(s, p)))
register("widest_paths", f"WITH RECURSIVE {TREE}, up(t, width) AS (SELECT dst, CAST(dst % 7 + 1 AS DOUBLE) FROM e WHERE src = -1 UNION ALL SELECT e.dst, least(up.width, e.dst % 7 + 1) FROM up JOIN e ON e.src = up.t) SELECT CAST(-1 AS BIGINT) AS s, t, width FROM up")(lambda s, p: distances.widest_paths((g := tree(s, p)).with_edges(g.edges.withColumn("weight", F.expr("dst % 7 + 1.0D"))), _roots(s, p)).where("t != -1"))

register("connected_components", f"WITH {SMALL_TREE} SELECT vs.v, CAST(CASE WHEN vs.v < {NATIONS} THEN vs.v ELSE e.src END AS BIGINT) AS component FROM vs LEFT JOIN e ON e.dst = vs.v")(lambda s, p: iterate.connected_components(small_tree(s, p)))
REACH = "rc(s, t) AS (SELECT v, v FROM vs UNION SELECT rc.s, e.dst FROM rc JOIN e ON e.src = rc.t)"
register("reachability", f"WITH RECURSIVE {TREE}, {REACH} SELECT s, t FROM rc")(lambda s, p: iterate.reachability(tree(s, p, True)))
register("strongly_connected_components", f"WITH RECURSIVE {TRADE}, {REACH} SELECT x.s AS v, min(x.t) AS component FROM rc x JOIN rc y ON x.s = y.t AND x.t = y.s GROUP BY 1")(lambda s, p: iterate.strongly_connected_components(trade(s, p)))
register("topological_levels", f"WITH RECURSIVE {TREE}, up(v, level) AS (SELECT CAST(-1 AS BIGINT), 0 UNION ALL SELECT e.dst, up.level + 1 FROM up JOIN e ON e.src = up.v) SELECT v, CAST(level AS BIGINT) AS level FROM up")(lambda s, p: iterate.topological_levels(tree(s, p, True)))
_ROUNDS = 6
_PR = "".join(f", r{i + 1} AS MATERIALIZED (SELECT vs.v, 0.15 / n + 0.85 * coalesce(g.x, 0) AS x FROM vs CROSS JOIN nn LEFT JOIN (SELECT b.u AS v, sum(r{i}.x / d.d) AS x FROM b JOIN r{i} ON r{i}.v = b.v JOIN d ON d.v = b.v GROUP BY 1) g ON g.v = vs.v)" for i in range(_ROUNDS))
register("pagerank", f"WITH {COPURCHASE}, {DEG}, nn AS (SELECT count(*) AS n FROM vs), r0 AS (SELECT vs.v, 1.0 / n AS x FROM vs, nn){_PR} SELECT v, {f32('x')} AS rank FROM r{_ROUNDS}")(lambda s, p: iterate.pagerank(copurchase(s, p), rounds=_ROUNDS))
register("pagerank_converged")(lambda s, p: iterate.pagerank(copurchase(s, p)))
register("power_step", f"WITH {COPURCHASE}, {DEG} SELECT b.v, {f32('sum(d.d)')} AS x FROM b JOIN d ON d.v = b.u GROUP BY 1")(lambda s, p: iterate.power_step(g := copurchase(s, p), g.degrees().select("v", F.col("d").cast("double").alias("x"))))
register("katz_centrality")(lambda s, p: iterate.katz_centrality(tree(s, p), 0.02))
register("hub_and_authority_scores")(lambda s, p: iterate.hub_and_authority_scores(copurchase(s, p)))
register("eigenvector_centrality")(lambda s, p: iterate.eigenvector_centrality(trade(s, p), tolerance=1e-7))
register("coreness", f"WITH {TREE} SELECT v, CAST(1 AS BIGINT) AS coreness FROM vs")(lambda s, p: iterate.coreness(tree(s, p)))
register("trussness", f"WITH {TREE} SELECT src AS a, dst AS b, CAST(2 AS BIGINT) AS truss FROM e")(lambda s, p: iterate.trussness(tree(s, p)))
register("minimum_spanning_forest", "SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) - 1 AS edges FROM lineitem")(lambda s, p: iterate.minimum_spanning_forest(_lightest(ordered(s, p))).agg(F.count("*").alias("edges")))
register("wl_colours", f"WITH {SMALL_TREE} SELECT CAST(CASE WHEN v < {NATIONS} THEN 5 ELSE 25 END AS BIGINT) AS size FROM (SELECT DISTINCT v < {NATIONS} AS top, CASE WHEN v < {NATIONS} THEN 0 ELSE {NATIONS} END AS v FROM vs)")(lambda s, p: iterate.wl_colours(small_tree(s, p), 2).groupBy("colour").agg(F.count("*").alias("size")).select("size"))
register("label_propagation")(lambda s, p: iterate.label_propagation(copurchase(s, p)))
register("label_spread")(lambda s, p: iterate.label_spread(tree(s, p), table(s, p, "region").selectExpr("cast(r_regionkey as long) as v", "cast(r_regionkey as long) as label"), 6))
register("random_walks")(lambda s, p: iterate.random_walks(g := tree(s, p), g.vertices.select(F.col("v").alias("walk"), "v"), 5, 1))

register("facts", f"WITH {TREE} SELECT name, value FROM (VALUES ('is_connected', true), ('is_simple', true), ('has_loop', false), ('has_multiple', false), ('is_tree', true), ('is_forest', true), ('is_regular', false), ('is_complete', false), ('is_eulerian_path', false), ('is_eulerian_cycle', false), ('is_empty_graph', false), ('is_path', false), ('is_cycle', false), ('is_star', false), ('is_unicyclic', false), ('is_cubic', false), ('is_subcubic', false), ('is_cactus_size', true)) x(name, value)")(lambda s, p: recognise.facts(tree(s, p)))
register("bipartite_sides", f"WITH RECURSIVE {TREE}, up(v, level) AS (SELECT CAST(-1 AS BIGINT), 0 UNION ALL SELECT e.dst, up.level + 1 FROM up JOIN e ON e.src = up.v) SELECT v, CAST(level % 2 AS BIGINT) AS side FROM up")(lambda s, p: recognise.bipartite_sides(tree(s, p)))
register("cut_points", f"WITH {TREE}, {DEG} SELECT 'articulation' AS kind, count(*) AS n FROM d WHERE d > 1 UNION ALL SELECT 'bridge', count(*) FROM e UNION ALL SELECT 'edge', count(*) FROM e")(lambda s, p: kernels.cut_points((g := tree(s, p)).with_edges(store(g.edges))).groupBy("kind").agg(F.count("*").alias("n")))
register("maximal_cliques", f"WITH {TREE} SELECT src AS a, dst AS b FROM e")(lambda s, p: kernels.maximal_cliques(tree(s, p)).select(F.col("clique")[0].alias("a"), F.col("clique")[1].alias("b")))
register("is_chordal", "SELECT CAST(-1 AS BIGINT) AS component, true AS chordal")(lambda s, p: kernels.is_chordal(tree(s, p)))
register("girth", "SELECT CAST(-1 AS BIGINT) AS component, CAST(NULL AS BIGINT) AS girth")(lambda s, p: kernels.girth(tree(s, p)))
register("greedy_coloring", "SELECT CAST(2 AS BIGINT) AS colors")(lambda s, p: kernels.greedy_coloring(tree(s, p)).agg((F.max("color") + 1).alias("colors")))
register("spectral_measures")(lambda s, p: kernels.spectral_measures(tree(s, p)))
register("spectral_star", f"WITH {SMALL_TREE} SELECT r_regionkey AS component, 'algebraic_connectivity' AS name, {f32('1.0')} AS value FROM region UNION ALL SELECT r_regionkey, 'spanning_tree_count', {f32('1.0')} FROM region UNION ALL SELECT r_regionkey, 'kirchhoff_index', {f32('25.0')} FROM region UNION ALL SELECT r_regionkey, 'spectral_radius', {f32('sqrt(5.0)')} FROM region")(
    lambda s, p: kernels.spectral_measures(small_tree(s, p)).where("name in ('algebraic_connectivity', 'spanning_tree_count', 'kirchhoff_index', 'spectral_radius')")
)
register("fiedler")(lambda s, p: kernels.fiedler(tree(s, p)))
register("st_flows", f"WITH {SMALL_TREE} SELECT r_regionkey AS s, CAST({NATIONS} + n_nationkey AS BIGINT) AS t, CAST(CASE WHEN r_regionkey = n_regionkey THEN 1 ELSE 0 END AS DOUBLE) AS value FROM region, nation")(
    lambda s, p: kernels.st_flows(small_tree(s, p), table(s, p, "region").selectExpr("cast(r_regionkey as long) as s").join(table(s, p, "nation").selectExpr(f"cast({NATIONS} + n_nationkey as long) as t")))
)
register("bipartite_matching", "SELECT count(*) AS size FROM region")(lambda s, p: kernels.bipartite_matching(small_tree(s, p)).agg(F.count("*").alias("size")))

_G = {
    "path": ("path_graph", (50,), "SELECT i AS src, i + 1 AS dst FROM generate_series(0, 48) t(i)"), "ring": ("ring_graph", (50,), "SELECT least(i, (i + 1) % 50), greatest(i, (i + 1) % 50) FROM generate_series(0, 49) t(i)"), "star": ("star_graph", (50,), "SELECT 0, i FROM generate_series(1, 49) t(i)"),
    "full": ("full_graph", (20,), "SELECT x.i, y.i FROM generate_series(0, 19) x(i) JOIN generate_series(0, 19) y(i) ON x.i < y.i"), "full_citation": ("full_citation", (20,), "SELECT x.i, y.i FROM generate_series(0, 19) x(i) JOIN generate_series(0, 19) y(i) ON x.i > y.i"), "wheel": ("wheel_graph", (11,), "SELECT 0, i FROM generate_series(1, 10) t(i) UNION ALL SELECT least(i, i % 10 + 1), greatest(i, i % 10 + 1) FROM generate_series(1, 10) t(i)"),
    "kary_tree": ("kary_tree", (100, 3), "SELECT (i - 1) // 3, i FROM generate_series(1, 99) t(i)"), "full_bipartite": ("full_bipartite", (5, 7), "SELECT x.i, y.i FROM generate_series(0, 4) x(i), generate_series(5, 11) y(i)"), "turan": ("turan_graph", (10, 3), "SELECT x.i, y.i FROM generate_series(0, 9) x(i) JOIN generate_series(0, 9) y(i) ON x.i < y.i AND (CASE WHEN x.i < 4 THEN 0 WHEN x.i < 7 THEN 1 ELSE 2 END) <> (CASE WHEN y.i < 4 THEN 0 WHEN y.i < 7 THEN 1 ELSE 2 END)"),
    "square_lattice": ("square_lattice", ([4, 5],), "SELECT x.i, y.i FROM generate_series(0, 19) x(i) JOIN generate_series(0, 19) y(i) ON x.i < y.i AND abs(x.i % 4 - y.i % 4) + abs(x.i // 4 - y.i // 4) = 1"), "hypercube": ("hypercube", (5,), "SELECT x.i, y.i FROM generate_series(0, 31) x(i) JOIN generate_series(0, 31) y(i) ON x.i < y.i AND bit_count(xor(x.i, y.i)) = 1"),
    "hamming": ("hamming_graph", (2, 4), "SELECT x.i, y.i FROM generate_series(0, 15) x(i) JOIN generate_series(0, 15) y(i) ON x.i < y.i AND (x.i % 4 = y.i % 4 OR x.i // 4 = y.i // 4)"), "circulant": ("circulant", (12, [1, 5, 11, 6]), "SELECT x.i, y.i FROM generate_series(0, 11) x(i) JOIN generate_series(0, 11) y(i) ON x.i < y.i AND (y.i - x.i) IN (1, 11, 5, 7, 6)"),
    "generalized_petersen": ("generalized_petersen", (5, 2), "SELECT least(i, (i + 1) % 5), greatest(i, (i + 1) % 5) FROM generate_series(0, 4) t(i) UNION ALL SELECT i, i + 5 FROM generate_series(0, 4) t(i) UNION ALL SELECT least(5 + i, 5 + (i + 2) % 5), greatest(5 + i, 5 + (i + 2) % 5) FROM generate_series(0, 4) t(i)"), "de_bruijn": ("de_bruijn", (2, 4), "SELECT t.i, (2 * t.i) % 16 + c.i FROM generate_series(0, 15) t(i), generate_series(0, 1) c(i)"),
    "lcf": ("lcf_graph", (14, [5, -5], 7), "SELECT DISTINCT least(i, j), greatest(i, j) FROM (SELECT i, (i + 1) % 14 AS j FROM generate_series(0, 13) t(i) UNION ALL SELECT i, (i + CASE WHEN i % 2 = 0 THEN 5 ELSE 9 END) % 14 FROM generate_series(0, 13) t(i))"),
}
for _name, (_function, _args, _sql) in _G.items():
    register(f"{_name}_graph", f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ({_sql}) x(src, dst)")(lambda s, p, f=getattr(made, _function), a=_args: f(s, *a).edges.select("src", "dst"))

register("running_mean", f"SELECT event_id, {f32('CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END')} AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")(
    lambda s, p: sequences.running_mean(table(s, p, "events"), "value", ["ts", "event_id"], 5, ["user_id"]).select("event_id", "running_mean")
)
register("neighborhood", f"WITH RECURSIVE {TREE}, {DIST} SELECT s AS v, t AS u FROM ds WHERE dist BETWEEN 1 AND 2")(lambda s, p: algebra.neighborhood(tree(s, p), 2, 1))
register("graph_power", f"WITH RECURSIVE {TREE}, {DIST} SELECT s AS src, t AS dst FROM ds WHERE s < t AND dist <= 3")(lambda s, p: algebra.graph_power(tree(s, p), 3).edges.select("src", "dst"))
register("reachability_counts", f"WITH RECURSIVE {TREE}, {REACH} SELECT s AS v, count(*) AS reached FROM rc GROUP BY 1")(lambda s, p: iterate.reachability(tree(s, p, True)).groupBy(F.col("s").alias("v")).agg(F.count("*").alias("reached")))
register("frustrated_edges", f"WITH {TREE} SELECT src, dst FROM e WHERE false")(lambda s, p: recognise.frustrated_edges(tree(s, p)).select("src", "dst"))
register("subgraph_from_edges", f"WITH {ORDERS}, m AS (SELECT eid FROM e GROUP BY eid HAVING max(weight) >= 25) SELECT src, dst, count(*) AS copies FROM e WHERE eid IN (SELECT eid FROM m) GROUP BY 1, 2")(
    lambda s, p: algebra.subgraph_from_edges(g := ordered(s, p), g.edges.groupBy("eid").agg(F.max("weight").alias("w")).where("w >= 25")).edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
)
_R = {
    "symmetric_tree": ("symmetric_tree", ([3, 2, 2],), "SELECT 0, i FROM generate_series(1, 3) t(i) UNION ALL SELECT 1 + (i - 4) // 2, i FROM generate_series(4, 9) t(i) UNION ALL SELECT 4 + (i - 10) // 2, i FROM generate_series(10, 21) t(i)"),
    "regular_tree": ("regular_tree", (2, 3), "SELECT 0, i FROM generate_series(1, 3) t(i) UNION ALL SELECT 1 + (i - 4) // 2, i FROM generate_series(4, 9) t(i)"),
    "triangular_lattice": ("triangular_lattice", (4, 5), "SELECT x.i, y.i FROM generate_series(0, 19) x(i) JOIN generate_series(0, 19) y(i) ON x.i < y.i AND ((y.i = x.i + 1 AND y.i % 5 > 0) OR y.i = x.i + 5 OR (y.i = x.i + 4 AND x.i % 5 > 0))"),
    "full_multipartite": ("full_multipartite", ([2, 3, 4],), "SELECT x.i, y.i FROM generate_series(0, 8) x(i) JOIN generate_series(0, 8) y(i) ON x.i < y.i AND (CASE WHEN x.i < 2 THEN 0 WHEN x.i < 5 THEN 1 ELSE 2 END) <> (CASE WHEN y.i < 2 THEN 0 WHEN y.i < 5 THEN 1 ELSE 2 END)"),
    "prufer": ("from_prufer", ([3, 3, 3, 4],), "SELECT * FROM (VALUES (0, 3), (1, 3), (2, 3), (3, 4), (4, 5)) v(a, b)"),
    "circular_lattice": ("square_lattice", ([4, 3], True), "SELECT least(i, (i // 4) * 4 + (i + 1) % 4), greatest(i, (i // 4) * 4 + (i + 1) % 4) FROM generate_series(0, 11) t(i) UNION ALL SELECT least(i, (i + 4) % 12), greatest(i, (i + 4) % 12) FROM generate_series(0, 11) t(i)"),
}
for _name, (_function, _args, _sql) in _R.items():
    register(f"{_name}_graph", f"SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ({_sql}) x(src, dst)")(lambda s, p, f=getattr(made, _function), a=_args: f(s, *a).edges.select("src", "dst"))
register("mycielskian", "SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM (SELECT least(i, (i + 1) % 5), greatest(i, (i + 1) % 5) FROM generate_series(0, 4) t(i) UNION ALL SELECT i, 5 + (i + 1) % 5 FROM generate_series(0, 4) t(i) UNION ALL SELECT (i + 1) % 5, 5 + i FROM generate_series(0, 4) t(i) UNION ALL SELECT 5 + i, 10 FROM generate_series(0, 4) t(i)) x(src, dst)")(
    lambda s, p: made.mycielskian(made.ring_graph(s, 5), 5).edges.select("src", "dst")
)
register("kautz_graph", "WITH w AS (SELECT a.i * 4 + (b.i - a.i + 3 - 1) % 3 * 2 + (c.i - b.i + 3 - 1) % 3 AS id, a.i AS a, b.i AS b, c.i AS c FROM generate_series(0, 2) a(i), generate_series(0, 2) b(i), generate_series(0, 2) c(i) WHERE a.i <> b.i AND b.i <> c.i) SELECT CAST(x.id AS BIGINT) AS src, CAST(y.id AS BIGINT) AS dst FROM w x JOIN w y ON x.b = y.a AND x.c = y.b")(lambda s, p: made.kautz(s, 2, 2).edges.select("src", "dst"))
for _name, _made in {
    "erdos_renyi_gnp": lambda s: random_graphs.erdos_renyi_gnp(s, 2000, 0.01, 1), "erdos_renyi_gnm": lambda s: random_graphs.erdos_renyi_gnm(s, 1000, 3000, 1), "random_geometric": lambda s: random_graphs.random_geometric(s, 2000, 0.05, 1, True),
    "stochastic_block_model": lambda s: random_graphs.stochastic_block_model(s, [100, 150], [[0.2, 0.02], [0.02, 0.1]], 1), "watts_strogatz": lambda s: random_graphs.watts_strogatz(s, 1000, 3, 0.1, 1), "growing_graph": lambda s: random_graphs.growing_graph(s, 1000, 2, 1),
}.items():
    register(_name)(lambda s, p, f=_made: f(s).edges.select("src", "dst"))
register("configuration_model")(lambda s, p: random_graphs.configuration_model(store(copurchase(s, p).degrees()), 1).edges.select("src", "dst"))


from lattica import catalogue_profiles  # noqa: E402, F401

from lattica import catalogue_centrality  # noqa: E402, F401

from lattica import catalogue_patterns  # noqa: E402, F401

from lattica import catalogue_paths  # noqa: E402, F401

from lattica import catalogue_communities  # noqa: E402, F401

from lattica import catalogue_places  # noqa: E402, F401

from lattica import catalogue_classes  # noqa: E402, F401

from lattica import catalogue_access  # noqa: E402, F401

from lattica import catalogue_flows  # noqa: E402, F401

from lattica import catalogue_cycles  # noqa: E402, F401
