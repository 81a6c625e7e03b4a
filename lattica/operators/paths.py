"""Traversals and paths as tables: search trees, one or all shortest paths, simple paths, neighbourhoods, cells, spanners.

Directions are a matter of the graph (``Graph.as_mode``), lengths of ``weight``. A path is a row with its
vertices in an array, or rows (path, i, v); what is found is as large as the number of paths asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.centrality import path_dag, path_table


def bfs(g: Graph, roots: DataFrame) -> DataFrame:
    """(s, v, dist, parent) for each root: steps, and the least vertex of the level before that has v as a neighbour; null for the root."""
    table = store(path_table(g, roots))
    return shortest_path_tree(g, table)


def shortest_path_tree(g: Graph, table: DataFrame, weight: str | None = None) -> DataFrame:
    """(s, v, dist, parent): the least vertex before v on a shortest path from s."""
    parent = path_dag(g, table, weight).groupBy("s", F.col("u").alias("t")).agg(F.min("v").alias("parent"))
    return table.join(parent, ["s", "t"], "left").select("s", F.col("t").alias("v"), "dist", "parent")


def shortest_paths(g: Graph, sources: DataFrame, targets: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(s, t, dist, path): one shortest path to each target that can be reached, backwards by least vertices; a row grows by its path."""
    table = store(path_table(g, sources, weight))
    tree = store(shortest_path_tree(g, table, weight))
    at = tree if targets is None else tree.join(targets.select("v").distinct(), "v", "left_semi")
    front = store(at.select("s", F.col("v").alias("t"), "dist", F.array("v").alias("path"), F.col("parent").alias("next")))
    done = front.where("next is null")
    front = front.where("next is not null")
    while not front.isEmpty():
        step = front.withColumnRenamed("next", "v").join(tree.select("s", "v", "parent"), ["s", "v"])
        step = store(step.select("s", "t", "dist", F.concat(F.array("v"), "path").alias("path"), F.col("parent").alias("next")))
        done, front = done.unionByName(step.where("next is null")), step.where("next is not null")
    return done.select("s", "t", "dist", "path")


def all_shortest_paths(g: Graph, sources: DataFrame, targets: DataFrame, weight: str | None = None) -> DataFrame:
    """(s, t, dist, path): every shortest path, once for each choice among parallel edges."""
    table = store(path_table(g, sources, weight))
    dag = store(path_dag(g, table, weight))
    front = store(table.join(targets.select(F.col("v").alias("t")).distinct(), "t", "left_semi").select("s", "t", "dist", F.array("t").alias("path"), F.col("t").alias("at")))
    done = front.where("at = s")
    front = front.where("at != s")
    while not front.isEmpty():
        step = front.withColumnRenamed("at", "u").join(dag.select("s", "u", "v"), ["s", "u"])
        step = store(step.select("s", "t", "dist", F.concat(F.array("v"), "path").alias("path"), F.col("v").alias("at")))
        done, front = done.unionByName(step.where("at = s")), step.where("at != s")
    return done.select("s", "t", "dist", "path")


def all_simple_paths(g: Graph, sources: DataFrame, targets: DataFrame | None = None, longest: int | None = None, weight: str | None = None) -> DataFrame:
    """(s, t, length, path): every path without a repeated vertex, of at least one and at most ``longest`` edges; exponentially many by their nature."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    steps = store(g.slots.where("v != u").select(F.col("v").alias("at"), "u", w.alias("w")))
    front, done, k = store(sources.select(F.col("v").alias("s"), F.col("v").alias("at"), F.lit(0.0).alias("length"), F.array("v").alias("path"))), None, 0
    while longest is None or k < longest:
        k += 1
        front = store(front.join(steps, "at").where(~F.array_contains("path", F.col("u"))).select("s", F.col("u").alias("at"), (F.col("length") + F.col("w")).alias("length"), F.concat("path", F.array("u")).alias("path")))
        done = front if done is None else done.unionByName(front)
        if front.isEmpty():
            break
    out = done.withColumnRenamed("at", "t")
    return (out if targets is None else out.join(targets.select(F.col("v").alias("t")).distinct(), "t", "left_semi")).select("s", "t", "length", "path")


def k_shortest_paths(g: Graph, source: int, target: int, k: int, weight: str | None = None) -> DataFrame:
    """(rank, length, path): the k shortest paths without a repeated vertex, ties by their vertices, from 1 on.

    Grown from the source together; of the growing paths those go that, with the least way left to the
    target, are longer than the k-th of the found ones can be.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    steps = store(g.slots.where("v != u").select(F.col("v").alias("at"), "u", w.alias("w")))
    back = Graph(g.vertices, g.edges, g.directed).as_mode("in" if g.directed else "out")
    left = store(path_table(back, g.vertices.where(F.col("v") == target), weight).select(F.col("t").alias("u"), F.col("dist").alias("rest")))
    front = g.vertices.where(F.col("v") == source).select(F.col("v").alias("at"), F.lit(0.0).alias("length"), F.array("v").alias("path"))
    found, bound = None, None
    while True:
        step = front.join(steps, "at").where(~F.array_contains("path", F.col("u"))).join(left, "u")
        step = step.select(F.col("u").alias("at"), (F.col("length") + F.col("w")).alias("length"), F.concat("path", F.array("u")).alias("path"), "rest")
        if bound is not None:
            step = step.where(F.col("length") + F.col("rest") <= bound * (1 + 1e-12))
        step = store(step)
        if step.isEmpty():
            break
        new = step.where(F.col("at") == target).select("length", "path")
        found = store((new if found is None else found.unionByName(new)).orderBy("length", "path").limit(k))
        if found.count() == k:
            bound = found.agg(F.max("length")).first()[0]
        front = step.where(F.col("at") != target).drop("rest")
    if found is None:
        return g.spark.createDataFrame([], "rank long, length double, path array<long>")
    ranked = sorted(((r.length, r.path) for r in found.collect()))  # k rows
    return g.spark.createDataFrame([(i + 1, x, p) for i, (x, p) in enumerate(ranked)], "rank long, length double, path array<long>")


def neighborhoods(g: Graph, order: int, least: int = 0, sources: DataFrame | None = None) -> DataFrame:
    """(v, u, dist): the vertices from ``least`` to ``order`` steps away."""
    table = path_table(g, sources, None, order)
    return table.where(F.col("dist") >= least).select(F.col("s").alias("v"), F.col("t").alias("u"), F.col("dist").cast("long").alias("dist"))


def neighborhood_graphs(g: Graph, order: int, least: int = 0) -> DataFrame:
    """(v, eid, src, dst): the edges among each vertex's neighbourhood."""
    near = store(neighborhoods(g, order, least))
    e = g.edges.select("eid", "src", "dst")
    return near.select("v", F.col("u").alias("src")).join(e, "src").join(near.select("v", F.col("u").alias("dst")), ["v", "dst"]).select("v", "eid", "src", "dst")


def local_scan_k(g: Graph, k: int, weight: str | None = None, them: Graph | None = None) -> DataFrame:
    """(v, scan): the edges, or their weight, among the vertices up to k steps away; of ``them``, if given, instead of the graph's own."""
    other = g if them is None else them
    near = store(neighborhoods(g, k))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = other.edges.select("src", "dst", w.alias("w"))
    inside = near.select("v", F.col("u").alias("src")).join(e, "src").join(near.select("v", F.col("u").alias("dst")), ["v", "dst"]).groupBy("v").agg(F.sum("w").alias("scan"))
    return g.vertices.select("v").join(inside, "v", "left").select("v", F.coalesce("scan", F.lit(0.0)).alias("scan"))


def connect_neighborhood(g: Graph, order: int) -> Graph:
    """The graph with an edge to every vertex from two to ``order`` steps away; edges that are there stay as they are."""
    far = neighborhoods(g, order, 2).select(F.col("v").alias("src"), F.col("u").alias("dst"))
    if not g.directed:
        far = far.where("src < dst")
    return Graph.from_edges(g.edges.select("src", "dst").unionByName(far), g.directed, g.vertices)


def voronoi(g: Graph, generators: DataFrame, weight: str | None = None) -> DataFrame:
    """(v, cell, dist): the generator with the shortest way to v, ties to the least; null where none reaches."""
    table = path_table(g, generators, weight)
    best = table.groupBy(F.col("t").alias("v")).agg(F.min(F.struct("dist", "s")).alias("b"))
    return g.vertices.select("v").join(best, "v", "left").select("v", F.col("b.s").alias("cell"), F.col("b.dist").alias("dist"))


def subcomponent(g: Graph, vertex: int) -> DataFrame:
    """(v): what can be reached from a vertex, itself included."""
    return path_table(g, g.vertices.where(F.col("v") == vertex)).select(F.col("t").alias("v"))


def vertex_path(edges: DataFrame, start: int) -> list[int]:
    """The vertices along a path of edges (i, src, dst), in the order of i, from ``start``; an edge that doesn't go on is an error. A path's edges come to the driver."""
    at, out = start, [start]
    for r in edges.orderBy("i").collect():
        if at not in (r.src, r.dst):
            raise ValueError(f"edge {r.i} doesn't start at {at}")
        at = r.dst if at == r.src else r.src
        out.append(at)
    return out


def expand_path_to_pairs(path: DataFrame) -> DataFrame:
    """(a, b): the consecutive vertices of a column ``path``."""
    return path.select(F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("p")).select("p.a", "p.b")


def eccentricities(g: Graph, weight: str | None = None) -> DataFrame:
    """(v, eccentricity): the farthest reachable vertex; radius and diameter are its least and its greatest."""
    return path_table(g, None, weight).groupBy(F.col("s").alias("v")).agg(F.max("dist").alias("eccentricity"))


def pseudo_diameter(g: Graph, start: int) -> DataFrame:
    """(source, target, dist): from the start to the farthest vertex, of least degree among those, and again from there until no farther one is found."""
    d, source, best = g.degrees(), start, None
    while True:
        table = path_table(g, g.vertices.where(F.col("v") == source)).join(d.withColumnRenamed("v", "t"), "t")
        far = table.orderBy(F.desc("dist"), "d", "t").first()
        if best is not None and far.dist <= best[2]:
            return g.spark.createDataFrame([best], "source long, target long, dist double")
        best, source = (source, far.t, float(far.dist)), far.t


def even_tarjan_reduction(g: Graph) -> Graph:
    """Directed: each vertex v as 2v -> 2v + 1 of capacity 1, each edge as both ways between the halves, of capacity n."""
    n = g.vertices.count()
    inner = g.vertices.select((2 * F.col("v")).alias("src"), (2 * F.col("v") + 1).alias("dst"), F.lit(1.0).alias("capacity"))
    ways = g.edges.select("src", "dst").unionByName(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    outer = ways.select((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst"), F.lit(float(n)).alias("capacity"))
    return Graph.from_edges(inner.unionByName(outer), True)


def fundamental_cycles(g: Graph) -> DataFrame:
    """(eid, length): the cycle that each edge outside a breadth-first forest closes, of an undirected graph; the forest is rooted at each component's least vertex."""
    from lattica.operators.iterate import connected_components

    roots = store(connected_components(g).select(F.col("component").alias("v")).distinct())
    tree = store(bfs(g, roots))
    # one tree edge for each vertex but the roots: the least edge to the parent
    kept = tree.where("parent is not null").select(F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst")).join(g.edges, ["src", "dst"]).groupBy("src", "dst").agg(F.min("eid").alias("eid")).select("eid")
    rest = store(g.edges.join(kept, "eid", "left_anti").select("eid", "src", "dst"))
    up = tree.select("v", "parent", "dist")
    climb = store(rest.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).cast("long").alias("length")))
    done = climb.where("a = b")
    climb = climb.where("a != b")
    while not climb.isEmpty():  # the deeper end climbs; both, if they are level
        x = climb.join(up.select(F.col("v").alias("a"), F.col("parent").alias("pa"), F.col("dist").alias("da")), "a").join(up.select(F.col("v").alias("b"), F.col("parent").alias("pb"), F.col("dist").alias("db")), "b")
        x = store(x.select("eid", F.expr("case when da >= db then pa else a end").alias("a"), F.expr("case when db >= da then pb else b end").alias("b"), F.expr("length + case when da = db then 2 else 1 end").cast("long").alias("length")))
        done, climb = done.unionByName(x.where("a = b")), x.where("a != b")
    return done.select("eid", "length")
