"""Registered queries of the centralities, modes, cutoffs, weights and diffusion, with SQL that lists paths and iterates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalogue import BOTH, COPURCHASE, DEG, TRADE, copurchase, f32, register, trade
from lattica.catalogue_profiles import AP, PARTNERS, partners, scalars
from lattica.graph import Graph, store
from lattica.operators import centrality, iterate

# Shortest distances by weight: paths of at most 2, 4, .. 32 edges.
BW = "bw AS MATERIALIZED (SELECT src AS v, dst AS u, eid, weight AS w FROM e UNION ALL SELECT dst, src, eid, weight FROM e)"
WP = (
    f"{BW}, w0 AS MATERIALIZED (SELECT s, t, min(dist) AS dist FROM (SELECT v AS s, v AS t, 0.0::DOUBLE AS dist FROM vs UNION ALL SELECT v, u, w FROM bw) GROUP BY 1, 2)"
    + "".join(f", w{i} AS MATERIALIZED (SELECT x.s, y.t, min(x.dist + y.dist) AS dist FROM w{i - 1} x JOIN w{i - 1} y ON x.t = y.s GROUP BY 1, 2)" for i in range(1, 6))
    + ", wp AS (SELECT * FROM w5)"
)


def path_counts(ap: str, steps: str, longest: int) -> str:
    """SQL: sg (s, t, dist, k), the shortest paths of a distance table, counted by their number of edges; steps (v, u, eid, w)."""
    parts = "p0 AS MATERIALIZED (SELECT v AS s, v AS t, 1.0::DOUBLE AS k FROM vs)"
    for i in range(1, longest + 1):
        parts += f", p{i} AS MATERIALIZED (SELECT p.s, x.u AS t, sum(p.k) AS k FROM p{i - 1} p JOIN {steps} x ON x.v = p.t JOIN {ap} a ON a.s = p.s AND a.t = p.t JOIN {ap} c ON c.s = p.s AND c.t = x.u WHERE a.dist + x.w = c.dist GROUP BY 1, 2)"
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(longest + 1))
    return f"{parts}, sg AS MATERIALIZED (SELECT q.s, q.t, max(a.dist) AS dist, sum(q.k) AS k FROM ({union}) q JOIN {ap} a ON a.s = q.s AND a.t = q.t GROUP BY 1, 2)"


_B1 = "b1 AS (SELECT src AS v, dst AS u, eid, 1.0 AS w FROM e UNION ALL SELECT dst, src, eid, 1.0 FROM e)"
STEPS_BY = f"{AP}, {_B1}, {path_counts('ap', 'b1', 6)}"
WEIGHTS_BY = f"{WP}, {path_counts('wp', 'bw', 10)}"


def _through(where: str = "true") -> str:
    return f"SELECT vs.v, coalesce((SELECT sum(x.k * y.k / z.k) / 2 FROM sg z JOIN sg x ON x.s = z.s JOIN sg y ON y.t = z.t AND y.s = x.t WHERE x.t = vs.v AND z.s <> vs.v AND z.t <> vs.v AND z.s <> z.t AND x.dist + y.dist = z.dist AND {where}), 0) AS betweenness FROM vs"


def _over(steps: str, where: str = "true") -> str:
    return f"SELECT e.eid, coalesce((SELECT sum(x.k * y.k / z.k) / 2 FROM sg z JOIN sg x ON x.s = z.s JOIN {steps} st ON st.v = x.t AND st.eid = e.eid JOIN sg y ON y.s = st.u AND y.t = z.t WHERE z.s <> z.t AND x.dist + st.w + y.dist = z.dist AND {where}), 0) AS betweenness FROM e"


def _rounded(sql: str, *keys: str) -> str:
    return f"SELECT {', '.join(keys)}, {f32('betweenness')} AS betweenness FROM ({sql})"


_FIRST, _LAST = "z.s < 10", "z.t >= 10"
_S, _T = "v < 10", "v >= 10"
for _name, _sql, _steps, _cond, _args in (
    ("", STEPS_BY, "b1", "true", {}),
    ("_cutoff", STEPS_BY, "b1", "z.dist <= 2", {"cutoff": 2}),
    ("_weighted", WEIGHTS_BY, "bw", "true", {"weight": "weight"}),
    ("_subset", STEPS_BY, "b1", f"{_FIRST} AND {_LAST}", {"sources": _S, "targets": _T}),
):

    def _flows(spark: SparkSession, sf_dir: str, which: int, args: dict) -> DataFrame:
        g = partners(spark, sf_dir)
        given = {k: g.vertices.where(x) if k in ("sources", "targets") else x for k, x in args.items()}
        return centrality.shortest_path_flows(g, **given)[which]

    register(f"vertex_betweenness{_name}", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_sql} " + _rounded(_through(_cond), "v"))(lambda s, p, a=_args: _flows(s, p, 0, a))
    register(f"edge_betweenness{_name}", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {_sql} " + _rounded(_over(_steps, _cond), "eid"))(lambda s, p, a=_args: _flows(s, p, 1, a))


def _centralities(ap: str, where: str = "true") -> str:
    return (
        f"SELECT v, CAST(count(dist) AS BIGINT) AS reach, coalesce({f32('sum(dist)')}, 0) AS farness, {f32('count(dist) / sum(dist)')} AS closeness, coalesce({f32('sum(1 / dist) / ((SELECT count(*) FROM vs) - 1)')}, 0) AS harmonic, coalesce({f32('max(dist)')}, 0) AS eccentricity "
        f"FROM vs LEFT JOIN {ap} a ON a.s = vs.v AND a.t <> vs.v AND {where} GROUP BY v"
    )


def _distances(spark: SparkSession, sf_dir: str, weight: str | None = None, cutoff: float | None = None) -> DataFrame:
    g = partners(spark, sf_dir)
    return centrality.distance_centralities(store(centrality.path_table(g, None, weight, cutoff)), g.vertices.count())


register("distance_centralities", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} " + _centralities("ap"))(lambda s, p: _distances(s, p))
register("distance_centralities_cutoff", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP} " + _centralities("ap", "a.dist <= 2"))(lambda s, p: _distances(s, p, None, 2))
register("distance_centralities_weighted", f"WITH {PARTNERS}, {WP} " + _centralities("wp"))(lambda s, p: _distances(s, p, "weight"))
register("mean_distance_weighted", f"WITH {PARTNERS}, {WP} SELECT {f32('avg(dist)')} AS mean_distance, {f32('max(dist)')} AS diameter, {f32('(SELECT min(x) FROM (SELECT max(dist) AS x FROM wp GROUP BY s))')} AS radius FROM wp WHERE s <> t")(
    lambda s, p: _distances(s, p, "weight").agg((F.sum("farness") / F.sum("reach")).alias("mean_distance"), F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"))
)
register("eccentricity_classes", f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP}, x AS (SELECT s AS v, max(dist) AS ecc FROM ap GROUP BY s) SELECT v, CAST(ecc AS DOUBLE) AS eccentricity, ecc = (SELECT min(ecc) FROM x) AS center, ecc = (SELECT max(ecc) FROM x) AS periphery FROM x")(
    lambda s, p: _classes(_distances(s, p))
)


def _classes(c: DataFrame) -> DataFrame:
    ends = c.agg(F.min("eccentricity").alias("low"), F.max("eccentricity").alias("high"))
    return c.crossJoin(F.broadcast(ends)).select("v", "eccentricity", (F.col("eccentricity") == F.col("low")).alias("center"), (F.col("eccentricity") == F.col("high")).alias("periphery"))  # one row


def _centralizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = partners(spark, sf_dir)
    n = g.vertices.count()
    d = g.degrees()
    between = centrality.shortest_path_flows(g)[0]
    near = centrality.distance_centralities(store(centrality.path_table(g)), n)
    made = {
        "centralization_degree_wrapper": centrality.centralization(d, "d", centrality.degree_tmax(n)), "centralization_betweenness_wrapper": centrality.centralization(between, "betweenness", centrality.betweenness_tmax(n)),
        "centralization_closeness_wrapper": centrality.centralization(near, "closeness", centrality.closeness_tmax(n)), "betweenness_centralization": centrality.centralization(between, "betweenness", (n - 1) * (n - 2)),
    }
    both = store(between.join(near, "v").join(d, "v"))
    cor = both.agg(F.corr("betweenness", "closeness").alias("value")).select(F.lit("centrality_correlation").alias("name"), "value")
    out = None
    for name, row in made.items():
        part = row.select(F.lit(name).alias("name"), F.col("centralization").alias("value"))
        out = part if out is None else out.unionByName(part)
    shares = both.crossJoin(F.broadcast(both.agg(F.sum("d").alias("sd"), F.sum("betweenness").alias("sb")))).selectExpr("d / sd as p", "betweenness / sb as q").withColumn("m", F.expr("(p + q) / 2"))  # one row
    js = shares.agg(F.sum(F.expr("(case when p > 0 then p * ln(p / m) else 0 end + case when q > 0 then q * ln(q / m) else 0 end) / 2")).alias("value")).select(F.lit("centrality_divergence").alias("name"), "value")
    ranks = store(both.withColumn("betweenness", F.round("betweenness", 9)))  # so that equal scores, summed in another order, tie
    both = ranks
    for c, r in (("d", "rd"), ("betweenness", "rb")):  # mean rank of ties, from the classes of equal values
        classes = both.groupBy(c).agg(F.count("*").alias("k"))
        below = classes.alias("x").join(classes.alias("y"), F.col(f"y.{c}") < F.col(f"x.{c}"), "left").groupBy(F.col(f"x.{c}").alias(c), F.col("x.k").alias("k")).agg(F.coalesce(F.sum("y.k"), F.lit(0)).alias("b"))
        ranks = ranks.join(below.select(c, F.expr("b + (k + 1) / 2").alias(r)), c)
    sp = ranks.agg(F.corr("rd", "rb").alias("value")).select(F.lit("centrality_rank_correlation").alias("name"), "value")
    return out.unionByName(cor).unionByName(js).unionByName(sp)


_CB = f"bt AS MATERIALIZED ({_through()}), cn AS (SELECT s AS v, ((SELECT count(*) FROM vs) - 1) / sum(dist) AS closeness FROM ap GROUP BY s), al AS (SELECT bt.v, betweenness AS b, closeness AS c, d FROM bt JOIN cn ON cn.v = bt.v JOIN d ON d.v = bt.v), an AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(d) AS sd, sum(b) AS sb FROM al)"
_CZ = {
    "centralization_degree_wrapper": "(SELECT (max(n) * max(d) - sum(d)) / max((n - 1) * (n - 2)) FROM al, an)", "centralization_betweenness_wrapper": "(SELECT (max(n) * max(b) - sum(b)) / max((n - 1) * (n - 1) * (n - 2) / 2) FROM al, an)",
    "centralization_closeness_wrapper": "(SELECT (max(n) * max(c) - sum(c)) / max((n - 1) * (n - 2) / (2 * n - 3)) FROM al, an)", "betweenness_centralization": "(SELECT (max(n) * max(b) - sum(b)) / max((n - 1) * (n - 2)) FROM al, an)", "centrality_correlation": "(SELECT corr(b, c) FROM al)",
    "centrality_divergence": "(SELECT sum((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2) FROM (SELECT d / sd AS p, b / sb AS q, (d / sd + b / sb) / 2 AS m FROM al, an))",
    "centrality_rank_correlation": "(SELECT corr(x, y) FROM (SELECT (SELECT avg(i) FROM (SELECT d, row_number() OVER (ORDER BY d) AS i FROM al) z WHERE z.d = al.d) AS x, (SELECT avg(i) FROM (SELECT round(b, 9) AS b, row_number() OVER (ORDER BY round(b, 9)) AS i FROM al) z WHERE z.b = round(al.b, 9)) AS y FROM al))",
}
register("centralizations", f"WITH RECURSIVE {PARTNERS}, {DEG}, {STEPS_BY}, {_CB} " + scalars(_CZ))(_centralizations)

register("convergence_degree", (
    f"WITH RECURSIVE {PARTNERS}, {BOTH}, {AP}, {_B1}, cd AS (SELECT b1.eid, b1.v, z.s, z.t FROM b1 JOIN ap x ON x.t = b1.v JOIN ap y ON y.s = b1.u JOIN ap z ON z.s = x.s AND z.t = y.t WHERE x.dist + 1 + y.dist = z.dist), "
    "ci AS (SELECT eid, v, count(DISTINCT s) AS i FROM cd GROUP BY 1, 2), c2 AS (SELECT eid, CAST(max(i) AS DOUBLE) AS i, CAST(min(i) AS DOUBLE) AS o FROM ci GROUP BY eid) "
    f"SELECT eid, i AS in_size, o AS out_size, {f32('(i - o) / (i + o)')} AS convergence FROM c2"
))(lambda s, p: centrality.convergence_degree(partners(s, p)))

_AS = "sa AS (SELECT sum(w) AS total, sum(w * x * y) AS xy, sum(w * x) AS x1, sum(w * y) AS y1, sum(w * x * x) AS x2, sum(w * y * y) AS y2 FROM (SELECT b.w, (SELECT sum(w) FROM z WHERE z.v = b.v) AS x, (SELECT sum(w) FROM z WHERE z.u = b.u) AS y FROM z b))"
_AR = f"SELECT {f32('(xy - x1 * y1 / total) / (sqrt(x2 - x1 * x1 / total) * sqrt(y2 - y1 * y1 / total))')} AS assortativity FROM sa"
register("assortativity_degree_weighted", f"WITH {PARTNERS}, {BW}, z AS (SELECT * FROM bw), {_AS} {_AR}")(lambda s, p: centrality.degree_assortativity(partners(s, p), "weight"))
register("assortativity_degree_directed", f"WITH {TRADE}, z AS (SELECT src AS v, dst AS u, count(*) AS w FROM e GROUP BY 1, 2), {_AS} {_AR}")(lambda s, p: centrality.degree_assortativity(trade(s, p)))
_WK = "wk AS (SELECT d.v, CAST(d.d AS BIGINT) AS degree, sum(bw.w) AS strength, sum(bw.w * x.d) AS wd, count(*) AS k, CASE WHEN count(*) = 1 THEN 0 ELSE (ln(sum(bw.w)) - sum(bw.w * ln(bw.w)) / sum(bw.w)) / ln(count(*)) END AS div FROM d JOIN bw ON bw.v = d.v JOIN d x ON x.v = bw.u GROUP BY 1, 2)"
register("weighted_neighbor_degrees", f"WITH {PARTNERS}, {DEG}, {BW}, {_WK} SELECT v, degree, {f32('strength')} AS strength, {f32('wd / strength')} AS knn FROM wk")(lambda s, p: centrality.weighted_neighbor_degrees(partners(s, p)).drop("weighted_degrees"))
register("knnk_weighted", f"WITH {PARTNERS}, {DEG}, {BW}, {_WK} SELECT degree, {f32('sum(wd) / sum(strength)')} AS knnk FROM wk GROUP BY 1")(lambda s, p: centrality.weighted_knnk(partners(s, p)))
register("diversity", f"WITH {PARTNERS}, {DEG}, {BW}, {_WK} SELECT v, {f32('div')} AS diversity FROM wk")(lambda s, p: centrality.diversity(partners(s, p)))
register("transitivity_barrat", f"WITH {PARTNERS}, {DEG}, {BW}, tb AS (SELECT x.v, sum((x.w + y.w) / 2) AS t FROM bw x JOIN bw y ON x.v = y.v AND x.u <> y.u JOIN b ON b.v = x.u AND b.u = y.u GROUP BY 1), {_WK} SELECT wk.v, CASE WHEN degree >= 2 THEN {f32('coalesce(t, 0) / (strength * (degree - 1))')} END AS transitivity FROM wk LEFT JOIN tb ON tb.v = wk.v")(
    lambda s, p: centrality.barrat_transitivity(partners(s, p))
)
register("degree_profile", f"WITH {COPURCHASE}, {DEG} SELECT v, d AS degree, d * d AS degree_squared, {f32('log2(d + 1)')} AS log_degree FROM d")(lambda s, p: centrality.degree_profile(copurchase(s, p)))
register("degree_correlation_vector", f"WITH {COPURCHASE}, {DEG} SELECT CAST(x.d AS BIGINT) AS degree, {f32('avg(y.d)')} AS knn FROM b JOIN d x ON x.v = b.v JOIN d y ON y.v = b.u GROUP BY 1")(lambda s, p: centrality.degree_correlation_vector(copurchase(s, p)))


def _by_degree(g: Graph) -> DataFrame:
    """Vertices by degree, least first, as an order."""
    d = store(g.degrees())
    below = d.alias("x").join(d.alias("y"), F.expr("struct(y.d, y.v) < struct(x.d, x.v)"), "left").groupBy(F.col("x.v").alias("v")).agg(F.count("y.v").alias("i"))
    return store(below)


register("rich_club_sequence", f"WITH {PARTNERS}, {DEG}, o AS (SELECT v, row_number() OVER (ORDER BY d, v) - 1 AS i FROM d) SELECT o.i, {f32('(SELECT count(*) FROM e JOIN o x ON x.v = src JOIN o y ON y.v = dst WHERE least(x.i, y.i) >= o.i) / nullif(((SELECT count(*) FROM vs) - o.i) * ((SELECT count(*) FROM vs) - o.i - 1) / 2, 0)')} AS edges FROM o")(
    lambda s, p: centrality.rich_club_sequence(g := partners(s, p), _by_degree(g))
)

# diffusion, walks and fixed points by iteration in SQL
_P = "tp AS MATERIALIZED (SELECT b.v, b.u, 1 / d.d AS p FROM b JOIN d ON d.v = b.v)"
_SIG = "x0 AS (SELECT v, CAST(v % 7 + 1 AS DOUBLE) AS x FROM vs)"
_signal = lambda g: g.vertices.selectExpr("v", "cast(v % 7 + 1 as double) as x")
register("heat_kernel_diffuse", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_P}, {_SIG}, hk AS (SELECT 0 AS i, v, x, exp(-1.5::DOUBLE) AS c FROM x0 UNION ALL SELECT hk.i + 1, tp.u, sum(hk.x * tp.p), max(hk.c) * 1.5 / (hk.i + 1) FROM hk JOIN tp ON tp.v = hk.v WHERE hk.i < 20 GROUP BY hk.i, tp.u) SELECT v, {f32('sum(x * c)')} AS x FROM hk GROUP BY v")(
    lambda s, p: centrality.heat_kernel_diffuse(g := partners(s, p), _signal(g), 1.5)
)
register("ppr_diffuse", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_P}, {_SIG}, pd AS (SELECT 0 AS i, v, x FROM x0 UNION ALL SELECT pd.i + 1, tp.u, 0.3 * max(x0.x) + 0.7 * sum(pd.x * tp.p) FROM pd JOIN tp ON tp.v = pd.v JOIN x0 ON x0.v = tp.u WHERE pd.i < 90 GROUP BY pd.i, tp.u) SELECT v, {f32('x')} AS x FROM pd WHERE i = 90")(
    lambda s, p: centrality.ppr_diffuse(g := partners(s, p), _signal(g), 0.3)
)
register("rwpe", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_P}, rw AS (SELECT v AS s, v, 0 AS i, 1.0::DOUBLE AS x FROM vs UNION ALL SELECT rw.s, tp.u, rw.i + 1, sum(rw.x * tp.p) FROM rw JOIN tp ON tp.v = rw.v WHERE rw.i < 5 GROUP BY rw.s, tp.u, rw.i), g AS (SELECT vs.v, CAST(k AS BIGINT) AS step FROM vs, generate_series(1, 5) z(k)) SELECT g.v, step, coalesce({f32('x')}, 0) AS p FROM g LEFT JOIN rw ON rw.s = g.v AND rw.v = g.v AND rw.i = g.step")(
    lambda s, p: centrality.rwpe(partners(s, p), 5)
)
register("attention_aggregate", f"WITH {PARTNERS}, {BW}, {_SIG} SELECT bw.v, {f32('sum(exp(w / 1000) * x) / sum(exp(w / 1000))')} AS x FROM bw JOIN x0 ON x0.v = bw.u GROUP BY 1")(lambda s, p: centrality.attention_aggregate(g := partners(s, p), _signal(g), g.edges.selectExpr("eid", "weight / 1000 as a")))
_LB = "lb AS (SELECT n_nationkey AS v, n_regionkey AS label FROM nation WHERE n_nationkey IN (SELECT v FROM vs))"


def _regions(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("cast(n_nationkey as long) as v", "cast(n_regionkey as long) as label").join(g.vertices, "v", "left_semi")


register("majority_labels", f"WITH {PARTNERS}, {BOTH}, {_LB}, kn AS (SELECT CAST(v AS BIGINT) AS v, CAST(label AS BIGINT) AS label FROM lb WHERE v % 2 = 0), vo AS (SELECT b.v, label, count(*) AS k FROM b JOIN kn ON kn.v = b.u GROUP BY 1, 2), be AS (SELECT v, label FROM vo QUALIFY row_number() OVER (PARTITION BY v ORDER BY k DESC, label DESC) = 1) SELECT vs.v, coalesce(kn.label, be.label, (SELECT max(label) FROM kn)) AS label FROM vs LEFT JOIN kn ON kn.v = vs.v LEFT JOIN be ON be.v = vs.v")(
    lambda s, p: centrality.majority_labels(g := partners(s, p), _regions(s, p, g).where("v % 2 = 0"))
)
_PC = "x AS (SELECT weight AS w, p.label AS x, q.label AS y FROM e JOIN lb p ON p.v = src JOIN lb q ON q.v = dst), gc AS (SELECT label, count(*) AS size, coalesce((SELECT sum(w * (CASE WHEN x.x = lb.label THEN 1 ELSE 0 END + CASE WHEN x.y = lb.label THEN 1 ELSE 0 END)) FROM x), 0) AS vol, coalesce((SELECT sum(w) FROM x WHERE x.x <> x.y AND lb.label IN (x.x, x.y)), 0) AS cut FROM lb GROUP BY label)"
register("partition_cuts", f"WITH {PARTNERS}, {_LB}, {_PC} SELECT {f32('max(cut / nullif(vol, 0))')} AS conductance, {f32('max(cut / size)')} AS expansion FROM gc")(lambda s, p: centrality.partition_cuts(g := partners(s, p), _regions(s, p, g), "weight"))
register("class_homophily", f"WITH {PARTNERS}, {BOTH}, {_LB}, y AS (SELECT p.label AS x, q.label AS y FROM b JOIN lb p ON p.v = b.v JOIN lb q ON q.v = b.u), c AS (SELECT label, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM lb) AS share, coalesce((SELECT avg(CASE WHEN y.x = y.y THEN 1.0 ELSE 0 END) FROM y WHERE y.x = lb.label), 0) AS h FROM lb GROUP BY label) SELECT {f32('avg((h - share) / (1 - share))')} AS class_homophily, {f32('(SELECT avg(CASE WHEN x <> y THEN 1.0 ELSE 0 END) FROM y)')} AS edge_heterophily FROM c")(
    lambda s, p: centrality.class_homophily(g := partners(s, p), _regions(s, p, g))
)


def strong_trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of customers to nations of suppliers, where more is traded than the mean of all directed pairs."""
    e = store(trade(spark, sf_dir).edges.where("src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    e = store(e.join(F.broadcast(e.agg(F.avg("weight").alias("mean"))), F.col("weight") > F.col("mean")).selectExpr("src", "dst", "src * 100 + dst as eid", "weight"))  # one row
    return Graph.from_edges(e, True)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in strong trade, in each mode."""
    g = strong_trade(spark, sf_dir)
    out = None
    for mode in ("out", "in", "all"):
        t = centrality.distance_centralities(store(centrality.path_table(g.as_mode(mode))), 1).selectExpr("v", f"'{mode}' as mode", "reach", "farness", "eccentricity")
        out = t if out is None else out.unionByName(t)
    return out


_DT = "f AS MATERIALIZED (SELECT c_nationkey AS a, s_nationkey AS c, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), e AS MATERIALIZED (SELECT CAST(a AS BIGINT) AS src, CAST(c AS BIGINT) AS dst FROM f WHERE k > (SELECT avg(k) FROM f)), vs AS (SELECT DISTINCT v FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e))"
_MODES = {"out": "SELECT src AS v, dst AS u FROM e", "in": "SELECT dst AS v, src AS u FROM e", "all": "SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e"}
_MW = ", ".join(f"b{m} AS ({x}), w{m} AS (SELECT v AS s, v AS t, 0 AS dist FROM vs UNION SELECT w{m}.s, b{m}.u, w{m}.dist + 1 FROM w{m} JOIN b{m} ON b{m}.v = w{m}.t WHERE w{m}.dist < 10), a{m} AS (SELECT s, t, min(dist) AS dist FROM w{m} GROUP BY 1, 2)" for m, x in _MODES.items())
register("distances_by_mode", f"WITH RECURSIVE {_DT}, {_MW} " + " UNION ALL ".join(f"SELECT s AS v, '{m}' AS mode, count(*) - 1 AS reach, CAST(sum(dist) AS DOUBLE) AS farness, CAST(max(dist) AS DOUBLE) AS eccentricity FROM a{m} GROUP BY s" for m in _MODES))(_modes)

# fixed points, run to their ends on both sides
_PN = "n1 AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM vs)"
for _name, _share, _args in (("", "1 / d.d", {}), ("_weighted", "bw.w / st.s", {"weight": "weight"})):
    _tp = f"{BW}, st AS (SELECT v, sum(w) AS s FROM bw GROUP BY v), tp AS MATERIALIZED (SELECT bw.v, bw.u, {_share} AS p FROM bw JOIN d ON d.v = bw.v JOIN st ON st.v = bw.v)"
    register(f"pagerank_partners{_name}", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_tp}, {_PN}, pr AS (SELECT 0 AS i, v, 1 / n AS x FROM vs, n1 UNION ALL SELECT pr.i + 1, tp.u, 0.15 / max(n) + 0.85 * sum(pr.x * tp.p) FROM pr JOIN tp ON tp.v = pr.v, n1 WHERE pr.i < 200 GROUP BY pr.i, tp.u) SELECT v, {f32('x')} AS rank FROM pr WHERE i = 200")(
        lambda s, p, a=_args: iterate.pagerank(partners(s, p), tolerance=1e-12, **a)
    )
register("personalized_pagerank", f"WITH RECURSIVE {PARTNERS}, {DEG}, {_P}, re AS (SELECT v, CASE WHEN v < 5 THEN 1.0 / (SELECT count(*) FROM vs WHERE v < 5) ELSE 0 END AS p FROM vs), pr AS (SELECT 0 AS i, v, 1.0::DOUBLE / (SELECT count(*) FROM vs) AS x FROM vs UNION ALL SELECT pr.i + 1, tp.u, 0.15 * max(re.p) + 0.85 * sum(pr.x * tp.p) FROM pr JOIN tp ON tp.v = pr.v JOIN re ON re.v = tp.u WHERE pr.i < 200 GROUP BY pr.i, tp.u) SELECT v, {f32('x')} AS rank FROM pr WHERE i = 200")(
    lambda s, p: iterate.pagerank(g := partners(s, p), tolerance=1e-12, reset=_uniform(g.vertices.where("v < 5")))
)


def _uniform(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", F.lit(1.0 / vertices.count()).alias("p"))


# the power method of A + I, by the largest value, in SQL over the sum of squares, scaled at the end
for _name, _w, _args in (("", "1.0", {}), ("_weighted", "bw.w / 1000", {"weight": "weight"})):
    register(f"eigenvector_partners{_name}", f"WITH RECURSIVE {PARTNERS}, {BW}, aw AS MATERIALIZED (SELECT v, u, {_w} AS w FROM bw UNION ALL SELECT v, v, 1.0 FROM vs), ev AS (SELECT 0 AS i, v, 1.0::DOUBLE AS x FROM vs UNION ALL SELECT * FROM (SELECT ev.i + 1, aw.u, sum(ev.x * aw.w) / sqrt(sum(sum(ev.x * aw.w)) OVER ()) AS x FROM ev JOIN aw ON aw.v = ev.v WHERE ev.i < 400 GROUP BY ev.i, aw.u)) SELECT v, {f32('x / (SELECT max(x) FROM ev WHERE i = 400)')} AS x FROM ev WHERE i = 400")(
        lambda s, p, a=_args: iterate.eigenvector_centrality(_scaled(partners(s, p)), tolerance=1e-12, **a)
    )


def _scaled(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges.withColumn("weight", F.col("weight") / 1000), g.directed)
