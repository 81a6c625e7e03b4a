"""The graph as matrices and lists, look-ups, and sums of what is in it. Matrices are rows (v, u, value) of what isn't zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real


def _w(weight: str | None):
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def get_adjacency(g: Graph, weight: str | None = None, kind: str = "both", loops: str = "twice") -> DataFrame:
    """(v, u, value); undirected: both triangles, upper or lower; loops none, once or twice."""
    e = g.edges.select("src", "dst", _w(weight).alias("w"))
    each = e.where("src != dst")
    if g.directed or kind == "upper":
        sides = each.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w")
    else:
        sides = each.select(F.col("dst").alias("v"), F.col("src").alias("u"), "w")
        if kind == "both":
            sides = sides.unionByName(each.select(F.col("src").alias("v"), F.col("dst").alias("u"), "w"))
    if loops != "none":
        times = 2.0 if loops == "twice" and not g.directed else 1.0
        sides = sides.unionByName(e.where("src = dst").select(F.col("src").alias("v"), F.col("dst").alias("u"), (F.col("w") * times).alias("w")))
    return sides.groupBy("v", "u").agg(real(F.sum("w")).alias("value"))


def get_laplacian(g: Graph, weight: str | None = None, normalization: str = "none") -> DataFrame:
    """(v, u, value): D - A; symmetric: I - D^-1/2 A D^-1/2; left: I - D^-1 A; right: I - A D^-1. D: out-strengths, 0 counts as no neighbour."""
    a = get_adjacency(g, weight)
    d = a.groupBy("v").agg(F.sum("value").alias("d"))
    off = a.where("v != u").join(d.withColumnRenamed("d", "dv"), "v").join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u", "left")
    scale = {"none": "1", "symmetric": "sqrt(dv * du)", "left": "dv", "right": "du"}[normalization]
    own = a.where("v = u").select("v", F.col("value").alias("loop"))
    diagonal = d.join(own, "v", "left").select("v", F.col("v").alias("u"), F.expr("d - coalesce(loop, 0)" if normalization == "none" else "1 - coalesce(loop, 0) / d").alias("value"))
    return off.select("v", "u", real(F.expr(f"-value / {scale}")).alias("value")).unionByName(diagonal.select("v", "u", real("value").alias("value")))


def get_stochastic(g: Graph, weight: str | None = None, by_columns: bool = False) -> DataFrame:
    """(v, u, value): the adjacency with rows, or columns, that sum to 1."""
    a = get_adjacency(g, weight)
    key = "u" if by_columns else "v"
    return a.join(a.groupBy(key).agg(F.sum("value").alias("s")), key).select("v", "u", (F.col("value") / F.col("s")).alias("value"))


def get_biadjacency(g: Graph, types: DataFrame, weight: str | None = None) -> DataFrame:
    """(v, u, value) between vertices of type false (v) and true (u), types being (v, type); edges within a type are left out."""
    e = g.both.where("v != u").select("v", "u", _w(weight).alias("w"))
    sides = e.join(types.where("not type").select("v"), "v", "left_semi").join(types.where("type").select(F.col("v").alias("u")), "u", "left_semi")
    return sides.groupBy("v", "u").agg(real(F.sum("w")).alias("value"))


def get_eids(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, eid): the least edge of each pair, null if there is none; direction counts if the graph is directed."""
    e = g.edges.select("src", "dst", "eid")
    if not g.directed:
        pairs = pairs.select("a", "b", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    else:
        pairs = pairs.select("a", "b", F.col("a").alias("src"), F.col("b").alias("dst"))
    found = e.groupBy("src", "dst").agg(F.min("eid").alias("eid"))
    return pairs.join(found, ["src", "dst"], "left").select("a", "b", "eid")


def are_adjacent(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, adjacent)."""
    return get_eids(g, pairs).select("a", "b", F.col("eid").isNotNull().alias("adjacent"))


def pair_similarities(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard, dice, inverse_log) of given pairs, by distinct neighbours whatever the direction; a vertex is fully like itself, but for inverse_log."""
    near = g.both.where("v != u").select("v", "u").distinct()
    d = near.groupBy("v").agg(F.count("*").cast("double").alias("d"))
    x = pairs.join(near.select(F.col("v").alias("a"), "u"), "a")
    common = x.join(near.select(F.col("v").alias("b"), "u"), ["b", "u"]).join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u")
    common = common.groupBy("a", "b").agg(F.count("*").alias("k"), F.sum(F.expr("case when du > 1 then 1 / ln(du) end")).alias("il"))
    t = pairs.join(common, ["a", "b"], "left").join(d.select(F.col("v").alias("a"), F.col("d").alias("x")), "a", "left").join(d.select(F.col("v").alias("b"), F.col("d").alias("y")), "b", "left").na.fill(0.0)
    same = F.col("a") == F.col("b")
    value = lambda x, own: F.when(same, F.lit(own)).otherwise(F.coalesce(F.expr(x), F.lit(0.0))).cast("double")
    return t.select("a", "b", value("k / nullif(x + y - k, 0)", 1.0).alias("jaccard"), value("2 * k / nullif(x + y, 0)", 1.0).alias("dice"), value("il", 0.0).alias("inverse_log"))


def edge_similarities(g: Graph, eids: DataFrame | None = None) -> DataFrame:
    """(eid, jaccard, dice) of the ends of edges."""
    e = g.edges if eids is None else g.edges.join(eids, "eid", "left_semi")
    ends = e.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"))
    return ends.join(pair_similarities(g, ends.select("a", "b").distinct()), ["a", "b"]).select("eid", "jaccard", "dice")


def degree_sequence(g: Graph, mode: str = "all") -> DataFrame:
    """(v, degree) in a mode; loops twice in mode all."""
    return g.degrees(mode).withColumnRenamed("d", "degree") if not g.directed or mode != "all" else g.as_mode("all").degrees().withColumnRenamed("d", "degree")


def sort_vertices_by_degree(g: Graph, mode: str = "all", descending: bool = True) -> DataFrame:
    """(v, degree), ordered, ties by id."""
    return degree_sequence(g, mode).orderBy(F.desc("degree") if descending else F.asc("degree"), "v")


def max_degree_vertex(g: Graph, mode: str = "all") -> DataFrame:
    """(v, degree) of the least vertex of highest degree; no row for an empty graph."""
    return degree_sequence(g, mode).groupBy(F.lit(1).alias("one")).agg(F.max(F.struct("degree", (-F.col("v")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("v"), F.col("b.degree").alias("degree"))


def strength_with_mode(g: Graph, weight: str = "weight", mode: str = "all", loops: bool = True) -> DataFrame:
    """(v, strength): weights of edges out of, into, or at each vertex."""
    h = Graph(g.vertices, g.edges if loops else g.edges.where("src != dst"), g.directed)
    return h.strength(weight, mode) if mode != "all" or not g.directed else h.as_mode("all").strength(weight)


def reciprocity_ratio(g: Graph) -> DataFrame:
    """(reciprocity_ratio): distinct arcs whose reverse is there, loops among them, over all edges; 1 if undirected."""
    if not g.directed:
        return g.spark.createDataFrame([(1.0,)], "reciprocity_ratio double")
    arcs = g.edges.select("src", "dst").distinct()
    back = arcs.join(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("k"))
    return back.crossJoin(g.edges.agg(F.count("*").alias("m"))).select(real(F.expr("k / m")).alias("reciprocity_ratio"))  # one row each


def normalized_dirichlet_energy(g: Graph, signal: DataFrame, weight: str | None = None) -> DataFrame:
    """(energy): the weighted squares of differences along edges over those of the signal (v, x) by degree; 0 without a signal."""
    e = g.edges.select("src", "dst", _w(weight).alias("w")).join(signal.select(F.col("v").alias("src"), F.col("x").alias("a")), "src").join(signal.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst")
    return e.agg(real(F.expr("coalesce(sum(w * (a - b) * (a - b)) / nullif(sum(w * (a * a + b * b)), 0), 0)")).alias("energy"))


def graph_summary(g: Graph) -> DataFrame:
    """(name, value): vertices, edges, density, degrees, components, loops and parallel edges."""
    from lattica.operators.profile import beside, component_sizes, edge_counts, named

    d = g.degrees().agg(F.count("*").cast("double").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.avg("d").alias("mean"))
    made = {
        "vertices": "n", "edges": "m", "directed": "1" if g.directed else "0", "density": f"m / (n * (n - 1)) * {1 if g.directed else 2}", "min_degree": "low", "max_degree": "high", "mean_degree": "mean", "components": "c",
        "is_connected": "case when c = 1 then 1 else 0 end", "self_loops": "loops", "multi_edges": "m - pairs",
    }
    return named(beside(d, component_sizes(g), edge_counts(g)), made)


def local_scan_subsets(g: Graph, subsets: DataFrame, weight: str | None = None) -> DataFrame:
    """(subset, scan): edges, or their weight, among the vertices of each subset (subset, v)."""
    e = g.edges.select("src", "dst", _w(weight).alias("w"))
    inside = subsets.withColumnRenamed("v", "src").join(e, "src").join(subsets.withColumnRenamed("v", "dst"), ["subset", "dst"]).groupBy("subset").agg(F.sum("w").alias("scan"))
    return subsets.select("subset").distinct().join(inside, "subset", "left").select("subset", real(F.coalesce("scan", F.lit(0.0))).alias("scan"))
