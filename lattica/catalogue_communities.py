"""Registered queries of communities; what has no SQL is tested on graphs with known communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalogue import f32, register
from lattica.catalogue_centrality import BW, _DT, _LB, _regions, strong_trade
from lattica.catalogue_profiles import PARTNERS, partners
from lattica.operators import communities

_Q = "x AS (SELECT weight AS w, p.label AS x, q.label AS y FROM e JOIN lb p ON p.v = src JOIN lb q ON q.v = dst), mm AS (SELECT sum(w) AS m FROM x)"
register("modularity_weighted", f"WITH {PARTNERS}, {_LB}, {_Q} SELECT {f32('(SELECT sum(CASE WHEN x = y THEN w ELSE 0 END) / max(m) FROM x, mm) - (SELECT sum(vol * vol) / max(4 * m * m) FROM (SELECT sum(w) AS vol FROM (SELECT x AS l, w FROM x UNION ALL SELECT y, w FROM x) GROUP BY l), mm)')} AS modularity")(
    lambda s, p: communities.modularity(g := partners(s, p), _regions(s, p, g), "weight")
)
register("modularity_directed", f"WITH {_DT}, {_LB}, x AS (SELECT p.label AS x, q.label AS y FROM e JOIN lb p ON p.v = src JOIN lb q ON q.v = dst), mm AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM x) SELECT {f32('(SELECT sum(CASE WHEN x = y THEN 1 ELSE 0 END) / max(m) FROM x, mm) - (SELECT sum((SELECT count(*) FROM x WHERE x.x = l.label) * (SELECT count(*) FROM x WHERE x.y = l.label)) / max(m * m) FROM (SELECT DISTINCT label FROM lb) l, mm)')} AS modularity")(
    lambda s, p: communities.modularity(g := strong_trade(s, p), _regions(s, p, g))
)
register("modularity_matrix", f"WITH {PARTNERS}, {BW}, k AS (SELECT v, sum(w) AS k FROM bw GROUP BY v) SELECT x.v, y.v AS u, {f32('coalesce((SELECT sum(w) FROM bw WHERE bw.v = x.v AND bw.u = y.v), 0) - x.k * y.k / (SELECT sum(k) FROM k)')} AS b FROM k x, k y")(lambda s, p: communities.modularity_matrix(partners(s, p), "weight"))
register("reindex_membership", f"WITH {PARTNERS}, {_LB}, fs AS (SELECT label, min(v) AS first FROM lb GROUP BY label), rk AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS i FROM fs) SELECT CAST(lb.v AS BIGINT) AS v, i AS label FROM lb JOIN rk ON rk.label = lb.label")(
    lambda s, p: communities.reindex_membership(_regions(s, p, partners(s, p)))
)


def _found(spark: SparkSession, sf_dir: str, method, **options) -> DataFrame:
    return method(partners(spark, sf_dir), **options)


for _name, _method, _options in (
    ("louvain", communities.louvain, {}), ("louvain_weighted", communities.louvain, {"weight": "weight"}), ("leiden", communities.leiden, {}), ("fast_greedy", communities.fast_greedy, {}), ("walktrap", communities.walktrap, {}),
    ("leading_eigenvector", communities.leading_eigenvector, {}), ("edge_betweenness_communities", communities.edge_betweenness_communities, {}), ("fluid_communities", communities.fluid_communities, {"k": 4}),
):
    register(_name, None)(lambda s, p, f=_method, o=_options: _found(s, p, f, **o))
register("community_voronoi", None)(lambda s, p: communities.community_voronoi(g := partners(s, p), g.vertices.where(F.col("v") < 8), "weight"))
