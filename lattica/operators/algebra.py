"""Graphs from graphs: multiset operators, products, projections, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph


def _counts(g: Graph, name: str) -> DataFrame:
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias(name))


def _multiset(a: Graph, b: Graph, copies: Column, vertices: DataFrame) -> Graph:
    if a.directed != b.directed:
        raise ValueError("both graphs must be directed, or neither")
    both = _counts(a, "ka").join(_counts(b, "kb"), ["src", "dst"], "full").na.fill(0, ["ka", "kb"])
    both = both.withColumn("k", copies).where("k > 0").select("src", "dst", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("_"))
    return Graph.from_edges(both.select("src", "dst"), a.directed, vertices)


def _all(a: Graph, b: Graph) -> DataFrame:
    return a.vertices.select("v").union(b.vertices.select("v")).distinct()


def union(a: Graph, b: Graph) -> Graph:
    """Each pair as often as in the graph that has it more often."""
    return _multiset(a, b, F.greatest("ka", "kb"), _all(a, b))


def intersection(a: Graph, b: Graph) -> Graph:
    return _multiset(a, b, F.least("ka", "kb"), _all(a, b))


def difference(a: Graph, b: Graph) -> Graph:
    return _multiset(a, b, F.greatest(F.lit(0), F.col("ka") - F.col("kb")), a.vertices)


def disjoint_union(a: Graph, b: Graph, shift: int) -> Graph:
    """``b`` with its ids moved by ``shift``, beside ``a``."""
    moved = b.edges.select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst"))
    return Graph.from_edges(a.edges.select("src", "dst").unionByName(moved), a.directed, a.vertices.select("v").union(b.vertices.select(F.col("v") + shift)))


def is_same_graph(a: Graph, b: Graph) -> bool:
    if a.directed != b.directed or a.vertices.count() != b.vertices.count():
        return False
    return _counts(a, "k").exceptAll(_counts(b, "k")).isEmpty() and _counts(b, "k").exceptAll(_counts(a, "k")).isEmpty()


def simplify(g: Graph, multiple: bool = True, loops: bool = True) -> Graph:
    e = g.edges.where("src != dst") if loops else g.edges
    return Graph.from_edges(e.select("src", "dst").distinct() if multiple else e.select("src", "dst"), g.directed, g.vertices)


def reverse(g: Graph) -> Graph:
    if not g.directed:
        return g
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    return g.with_edges(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def to_directed(g: Graph, how: str = "mutual") -> Graph:
    pairs = g.edges.select("src", "dst")
    if how == "mutual":
        pairs = pairs.unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph.from_edges(pairs, True, g.vertices)


def to_undirected(g: Graph, how: str = "collapse") -> Graph:
    """each: every edge; collapse: one edge a pair (and a loop a vertex); mutual: pairs with both directions, no loops."""
    pairs = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), (F.col("src") <= F.col("dst")).alias("up"))
    if how == "each":
        kept = pairs
    elif how == "collapse":
        kept = pairs.select("src", "dst").distinct()
    else:
        kept = pairs.where("src != dst").groupBy("src", "dst").agg(F.bool_or("up").alias("a"), F.bool_or(~F.col("up")).alias("b")).where("a and b")
    return Graph.from_edges(kept.select("src", "dst"), False, g.vertices)


def complementer(g: Graph, loops: bool = False) -> Graph:
    """Pairs without an edge: n squared by definition, so the pair table is the result."""
    x, y = g.vertices.select(F.col("v").alias("src")), g.vertices.select(F.col("v").alias("dst"))
    pairs = x.join(y, F.lit(True) if g.directed else F.col("src") <= F.col("dst"))
    if not loops:
        pairs = pairs.where("src != dst")
    return Graph.from_edges(pairs.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti"), g.directed, g.vertices)


def induced_subgraph(g: Graph, keep: DataFrame) -> Graph:
    """The vertices in ``keep`` (v) and the edges between them."""
    e = g.edges.join(keep.select(F.col("v").alias("src")), "src", "left_semi").join(keep.select(F.col("v").alias("dst")), "dst", "left_semi")
    return Graph(g.vertices.join(keep.select("v"), "v", "left_semi"), e, g.directed)


def subgraph_from_edges(g: Graph, keep: DataFrame, delete_vertices: bool = True) -> Graph:
    e = g.edges.join(keep.select("eid"), "eid", "left_semi")
    return Graph.from_edges(e, g.directed, None if delete_vertices else g.vertices)


def delete_edges(g: Graph, drop: DataFrame) -> Graph:
    return Graph(g.vertices, g.edges.join(drop.select("eid"), "eid", "left_anti"), g.directed)


def delete_vertices(g: Graph, drop: DataFrame) -> Graph:
    return induced_subgraph(g, g.vertices.join(drop.select("v"), "v", "left_anti"))


def contract_vertices(g: Graph, mapping: DataFrame) -> Graph:
    """Vertices replaced by their group, (v, to); loops and parallel edges stay."""
    e = g.edges.join(mapping.select(F.col("v").alias("src"), F.col("to").alias("a")), "src").join(mapping.select(F.col("v").alias("dst"), F.col("to").alias("b")), "dst")
    return Graph.from_edges(e.select("eid", F.col("a").alias("src"), F.col("b").alias("dst")), g.directed, mapping.select(F.col("to").alias("v")).distinct())


def permute_vertices(g: Graph, mapping: DataFrame) -> Graph:
    return contract_vertices(g, mapping)


def line_graph(g: Graph) -> Graph:
    """Edges become vertices; undirected edges are adjacent once for each end they share, directed ones where one ends and the other starts."""
    vertices = g.edges.select(F.col("eid").alias("v"))
    if g.directed:
        a, b = g.edges.select(F.col("eid").alias("src"), F.col("dst").alias("at")), g.edges.select(F.col("eid").alias("dst"), F.col("src").alias("at"))
        return Graph.from_edges(a.join(b, "at").select("src", "dst"), True, vertices)
    ends = g.both.select("v", "eid")
    pairs = ends.select("v", F.col("eid").alias("src")).join(ends.select("v", F.col("eid").alias("dst")), "v").where("src < dst")
    return Graph.from_edges(pairs.select("src", "dst"), False, vertices)


def compose(a: Graph, b: Graph) -> Graph:
    """Two steps, the first in ``a``, the second in ``b``; undirected graphs are walked both ways on both sides."""
    x, y = (g.edges.select("src", "dst") if g.directed else g.both.select(F.col("v").alias("src"), F.col("u").alias("dst")) for g in (a, b))
    steps = x.select("src", F.col("dst").alias("at")).join(y.select(F.col("src").alias("at"), "dst"), "at")
    return Graph.from_edges(steps.select("src", "dst"), a.directed, _all(a, b))


def product(a: Graph, b: Graph, kind: str, n_b: int) -> Graph:
    """cartesian, tensor, strong, lexicographic or modular-free products of simple graphs; the pair (x, y) is x * n_b + y."""
    vx, vy = a.vertices.select(F.col("v").alias("x")), b.vertices.select(F.col("v").alias("y"))
    ea, eb = a.edges.select(F.col("src").alias("x1"), F.col("dst").alias("x2")), b.edges.select(F.col("src").alias("y1"), F.col("dst").alias("y2"))
    at = lambda x, y: F.col(x) * n_b + F.col(y)
    along_b = vx.join(eb).select(at("x", "y1").alias("src"), at("x", "y2").alias("dst"))
    along_a = ea.join(vy).select(at("x1", "y").alias("src"), at("x2", "y").alias("dst"))
    tensor = ea.join(eb).select(at("x1", "y1").alias("src"), at("x2", "y2").alias("dst"))
    if not a.directed:
        tensor = tensor.unionByName(ea.join(eb).select(at("x1", "y2").alias("src"), at("x2", "y1").alias("dst")))
    ys = b.vertices.select(F.col("v").alias("y2"))
    lexicographic = ea.join(vy).join(ys).select(at("x1", "y").alias("src"), at("x2", "y2").alias("dst")).unionByName(along_b)
    edges = {"cartesian": along_a.unionByName(along_b), "tensor": tensor, "strong": along_a.unionByName(along_b).unionByName(tensor), "lexicographic": lexicographic}[kind]
    return Graph.from_edges(edges, a.directed, vx.join(vy).select(at("x", "y").alias("v")))


def bipartite_projection(edges: DataFrame, side: str, via: str) -> DataFrame:
    """(a, b, multiplicity): pairs of ``side`` that share a ``via`` vertex, and how many two-paths join them."""
    x = edges.select(F.col(side).alias("a"), F.col(via).alias("m")).groupBy("a", "m").agg(F.count("*").alias("ka"))
    y = x.select(F.col("a").alias("b"), "m", F.col("ka").alias("kb"))
    return x.join(y, "m").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ka") * F.col("kb")).alias("multiplicity"))


def edge_flags(g: Graph) -> DataFrame:
    """(eid, is_loop, is_multiple, count_multiple, is_mutual): multiple is every copy but the first by eid."""
    same = Window.partitionBy("src", "dst")
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("back", F.lit(True))
    e = g.edges.select("eid", "src", "dst", (F.row_number().over(same.orderBy("eid")) > 1).alias("is_multiple"), F.count("*").over(same).alias("count_multiple"))
    e = e.join(back, ["src", "dst"], "left")
    return e.select("eid", (F.col("src") == F.col("dst")).alias("is_loop"), "is_multiple", "count_multiple", (F.lit(not g.directed) | F.coalesce("back", F.lit(False))).alias("is_mutual"))


def neighborhood(g: Graph, order: int, mindist: int = 0, sources: DataFrame | None = None) -> DataFrame:
    """(v, u): vertices at a distance from ``mindist`` to ``order``."""
    from lattica.operators.distances import distances

    return distances(g, sources, order).where(F.col("dist") >= mindist).select(F.col("s").alias("v"), F.col("t").alias("u"))


def graph_power(g: Graph, k: int) -> Graph:
    """An edge for every pair at a distance from 1 to ``k``."""
    pairs = neighborhood(g, k, 1).select(F.col("v").alias("src"), F.col("u").alias("dst"))
    return Graph.from_edges(pairs if g.directed else pairs.where("src < dst"), g.directed, g.vertices)


def rewire_edges(g: Graph, p: float, seed: int, n: int) -> Graph:
    """Each end moves to a uniform vertex 0..n-1 with probability ``p``; draws are hashes of the edge id, so reruns agree."""
    u = lambda *x: F.pmod(F.xxhash64("eid", F.lit(seed), *[F.lit(i) for i in x]), F.lit(1 << 30)) / float(1 << 30)
    moved = lambda c, i: F.when(u(i, 0) < p, F.floor(u(i, 1) * n).cast("long")).otherwise(F.col(c))
    return g.with_edges(g.edges.select("eid", moved("src", 1).alias("src"), moved("dst", 2).alias("dst")))


def sample_edges(g: Graph, share: float, seed: int) -> DataFrame:
    """Edges kept with probability ``share`` by the hash of their id."""
    return g.edges.where(F.pmod(F.xxhash64("eid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
