"""Sets of vertices and edges: what they are, as one aggregation each, and greedy or exact ones a component at a time."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.kernels import adjacency, maximal_cliques, per_component


def _within(g: Graph, vertices: DataFrame) -> DataFrame:
    near = g.both.where("v != u").select("v", "u").distinct()
    return near.join(vertices.select("v").distinct(), "v", "left_semi").join(vertices.select(F.col("v").alias("u")).distinct(), "u", "left_semi")


def is_clique(g: Graph, vertices: DataFrame, directed: bool = False) -> bool:
    """Whether every two of the vertices (v) are adjacent; in both directions, if ``directed``."""
    n = vertices.select("v").distinct().count()
    if directed and g.directed:
        one_way = g.edges.where("src != dst").select(F.col("src").alias("v"), F.col("dst").alias("u")).distinct()
        held = one_way.join(vertices.select("v").distinct(), "v", "left_semi").join(vertices.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        return held.count() == n * (n - 1)
    return _within(g, vertices).count() == n * (n - 1)


def is_independent_vertex_set(g: Graph, vertices: DataFrame) -> bool:
    return _within(g, vertices).isEmpty()


def is_vertex_cover(g: Graph, vertices: DataFrame) -> bool:
    """Whether every edge has an end among them."""
    return g.edges.join(vertices.select(F.col("v").alias("src")), "src", "left_anti").join(vertices.select(F.col("v").alias("dst")), "dst", "left_anti").isEmpty()


def is_dominating_set(g: Graph, vertices: DataFrame) -> bool:
    """Whether every other vertex has a neighbour among them."""
    near = g.both.join(vertices.select("v"), "v", "left_semi").select(F.col("u").alias("v"))
    return g.vertices.select("v").join(vertices.select("v").unionByName(near), "v", "left_anti").isEmpty()


def is_edge_cover(g: Graph, edges: DataFrame) -> bool:
    """Whether every vertex is on one of the edges (eid)."""
    return g.vertices.select("v").join(g.both.join(edges.select("eid"), "eid", "left_semi").select("v"), "v", "left_anti").isEmpty()


def is_matching(g: Graph, edges: DataFrame) -> bool:
    """Whether no two of the edges (eid) share an end; loops aren't allowed."""
    ends = g.edges.join(edges.select("eid").distinct(), "eid", "left_semi").select(F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy("v").count().where("count > 1").isEmpty()


def is_maximal_matching(g: Graph, edges: DataFrame) -> bool:
    """Whether it is a matching and every edge touches it."""
    on = store(g.edges.join(edges.select("eid").distinct(), "eid", "left_semi").select(F.explode(F.array("src", "dst")).alias("v")).distinct())
    free = g.edges.where("src != dst").join(on.select(F.col("v").alias("src")), "src", "left_anti").join(on.select(F.col("v").alias("dst")), "dst", "left_anti")
    return is_matching(g, edges) and free.isEmpty()


def is_perfect_matching(g: Graph, edges: DataFrame) -> bool:
    return is_matching(g, edges) and is_edge_cover(g, edges)


def is_vertex_coloring(g: Graph, colors: DataFrame) -> bool:
    """Whether the ends of every edge that isn't a loop differ in (v, color)."""
    e = g.edges.where("src != dst").join(colors.select(F.col("v").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("v").alias("dst"), F.col("color").alias("b")), "dst")
    return e.where("a = b").isEmpty()


def is_bipartite_coloring(g: Graph, colors: DataFrame) -> bool:
    """Whether it is a colouring of two colours at most."""
    return is_vertex_coloring(g, colors) and colors.select("color").distinct().count() <= 2


def is_edge_coloring(g: Graph, colors: DataFrame) -> bool:
    """Whether edges that share an end differ in (eid, color)."""
    return g.both.where("v != u").select("v", "eid").join(colors, "eid").groupBy("v", "color").agg(F.count_distinct("eid").alias("k")).where("k > 1").isEmpty()


def is_clique_cover(g: Graph, parts: DataFrame) -> bool:
    """Whether (v, part) has every vertex once and every part is a clique."""
    n, once = parts.count(), parts.select("v").distinct().count()
    if n != once or n != g.vertices.count():
        return False
    e = g.both.where("v != u").select("v", "u").distinct().join(parts, "v").join(parts.select(F.col("v").alias("u"), F.col("part").alias("q")), "u").where("part = q").groupBy("part").agg(F.count("*").alias("k"))
    return parts.groupBy("part").agg(F.count("*").alias("n")).join(e, "part", "left").where("coalesce(k, 0) != n * (n - 1)").isEmpty()


def cut_value(g: Graph, side: DataFrame, weight: str | None = None) -> DataFrame:
    """(value): edges, or their weight, between the vertices (v) and the rest."""
    x = side.select("v").distinct().withColumn("x", F.lit(True))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = g.edges.select("src", "dst", w.alias("w")).join(x.select(F.col("v").alias("src"), F.col("x").alias("a")), "src", "left").join(x.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst", "left")
    return e.agg(F.coalesce(F.sum(F.expr("case when (a is null) != (b is null) then w end")), F.lit(0.0)).alias("value"))


def bandwidth_of_labeling(g: Graph, labels: DataFrame) -> DataFrame:
    """(bandwidth): the largest difference of (v, label) along an edge."""
    e = g.edges.join(labels.select(F.col("v").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("v").alias("dst"), F.col("label").alias("b")), "dst")
    return e.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0)).cast("long").alias("bandwidth"))


# Cliques and independent sets, from the table of maximal cliques


def clique_sizes(g: Graph) -> DataFrame:
    """(size, cliques): how many maximal cliques there are of each size; the largest is the clique number."""
    return maximal_cliques(g).groupBy(F.size("clique").cast("long").alias("size")).agg(F.count("*").alias("cliques"))


def largest_cliques(g: Graph) -> DataFrame:
    """(clique): the maximal cliques of the largest size."""
    c = store(maximal_cliques(g))
    top = c.agg(F.max(F.size("clique")).alias("top"))
    return c.join(F.broadcast(top), F.size("clique") == F.col("top")).select("clique")  # one row


def cliques(g: Graph, size: int) -> DataFrame:
    """(clique): every clique of a size, its vertices ascending, grown by joins."""
    from lattica.operators.patterns import embeddings

    if size == 1:
        return g.vertices.select(F.array("v").alias("clique"))
    found = embeddings(g, (size, list(combinations(range(size), 2))))
    return found.select(F.array_sort(F.array(*[f"p{i}" for i in range(size)])).alias("clique"))


def weighted_cliques(g: Graph, weights: DataFrame) -> DataFrame:
    """(clique, weight) of maximal cliques, by (v, w); the largest weight is the weighted clique number where no weight is negative."""
    c = store(maximal_cliques(g)).withColumn("id", F.monotonically_increasing_id())
    w = c.select("id", F.explode("clique").alias("v")).join(weights, "v").groupBy("id").agg(F.sum("w").cast("double").alias("weight"))
    return c.join(w, "id").select("clique", "weight")


def maximal_independent_sets(g: Graph) -> DataFrame:
    """(clique): the maximal cliques of the complement, which is as large as the graph has pairs without an edge."""
    from lattica.operators.algebra import complementer

    return maximal_cliques(complementer(g))


# Greedy and exact sets, a component a task


def greedy_sets(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(kind, id): a maximal independent set (vertices by degree, then id), a maximal matching (edges in order), and a dominating set (the vertex that covers most, then id)."""

    def kernel(vertices, edges):
        near = adjacency(vertices, edges)
        gone: set[int] = set()
        for v in sorted(vertices, key=lambda x: (len(near[x]), x)):
            if v not in gone:
                yield "independent", v
                gone |= near[v] | {v}
        used: set[int] = set()
        for eid, a, b in edges:
            if a != b and a not in used and b not in used:
                used |= {a, b}
                yield "matching", eid
        open_ = set(vertices)
        while open_:
            v = max(vertices, key=lambda x: (len((near[x] | {x}) & open_), -x))
            open_ -= near[v] | {v}
            yield "dominating", v

    return per_component(g, kernel, "kind string, id long", most_edges)


def _largest_independent(near: dict[int, set[int]], left: frozenset) -> set[int]:
    """Branching on a vertex of highest degree; vertices of degree one or none are taken at once."""
    stack, best = [(left, frozenset())], frozenset()
    while stack:
        left, taken = stack.pop()
        while True:
            easy = next((v for v in sorted(left) if len(near[v] & left) <= 1), None)
            if easy is None:
                break
            taken, left = taken | {easy}, left - near[easy] - {easy}
        if len(taken) + len(left) <= len(best):
            continue
        if not left:
            best = taken
            continue
        v = max(sorted(left), key=lambda x: len(near[x] & left))
        stack += [(left - {v}, taken), (left - near[v] - {v}, taken | {v})]
    return set(best)


def optimal_sets(g: Graph, most_edges: int = 400) -> DataFrame:
    """(kind, id): a maximum independent set and the vertex cover it leaves, of each component; exponential, so for small components."""

    def kernel(vertices, edges):
        best = _largest_independent(adjacency(vertices, edges), frozenset(vertices))
        for v in vertices:
            yield ("independent" if v in best else "cover"), v

    return per_component(g, kernel, "kind string, id long", most_edges)


def colorings(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(kind, id, color): vertices coloured greedily, those of highest degree first, and edges in order with the least colour free at both ends."""

    def kernel(vertices, edges):
        near, color = adjacency(vertices, edges), {}
        for v in sorted(vertices, key=lambda x: (-len(near[x]), x)):
            taken = {color[u] for u in near[v] if u in color}
            color[v] = next(c for c in range(len(taken) + 1) if c not in taken)
            yield "vertex", v, color[v]
        used: dict[int, set[int]] = {v: set() for v in vertices}
        for eid, a, b in edges:
            if a != b:
                c = next(c for c in range(len(used[a]) + len(used[b]) + 1) if c not in used[a] and c not in used[b])
                used[a].add(c)
                used[b].add(c)
                yield "edge", eid, c

    return per_component(g, kernel, "kind string, id long, color long", most_edges)


def greedy_clique_cover(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(v, part): each vertex, by id, joins the first clique that it extends."""

    def kernel(vertices, edges):
        near, parts = adjacency(vertices, edges), []
        for v in vertices:
            for members in parts:
                if members <= near[v]:
                    members.add(v)
                    break
            else:
                parts.append({v})
        yield from ((v, min(members)) for members in parts for v in members)

    return per_component(g, kernel, "v long, part long", most_edges)
