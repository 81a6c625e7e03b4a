"""Whether a graph is of a class: from its degree classes, its components, its distances, what is left without its leaves, or a kernel.

Answers about degrees come from the table of degree classes, which has at most about sqrt(2m) rows and is the
only thing that reaches the driver. Directed graphs are not of the undirected classes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.iterate import connected_components
from lattica.operators.kernels import adjacency, per_component


def _runs(degrees: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """(degree, how many), the largest first."""
    return sorted(((int(d), int(k)) for d, k in degrees if k), reverse=True)


def degree_classes(g: Graph) -> list[tuple[int, int]]:
    return _runs((r.d, r.k) for r in g.degrees().groupBy("d").agg(F.count("*").alias("k")).collect())  # a row for each degree


def is_graphical(degrees: Iterable[tuple[int, int]], loops: bool = False, multiple: bool = False) -> bool:
    """Whether (degree, how many) is the degree sequence of an undirected graph, simple or with loops or parallel edges (Erdős and Gallai).

    Checked at the ends of runs of equal degrees only, where the condition is tightest.
    """
    runs = _runs(degrees)
    if any(d < 0 for d, _ in runs) or sum(d * k for d, k in runs) % 2:
        return False
    if loops and multiple or not runs:
        return True
    if multiple:  # no loops: the largest can be served by the others
        return 2 * runs[0][0] <= sum(d * k for d, k in runs)
    at, left = 0, 0
    for i, (d, k) in enumerate(runs):
        at, left = at + k, left + d * k
        right = at * (at + 1 if loops else at - 1) + sum(min(at, e) * c for e, c in runs[i + 1 :])
        if left > right:
            return False
    return True


def is_bigraphical(first: Iterable[tuple[int, int]], second: Iterable[tuple[int, int]], multiple: bool = False) -> bool:
    """Whether two (degree, how many) are the sides of a bipartite graph (Gale and Ryser)."""
    a, b = _runs(first), _runs(second)
    if sum(d * k for d, k in a) != sum(d * k for d, k in b) or any(d < 0 for d, _ in a + b):
        return False
    at, left = 0, 0
    for d, k in () if multiple else a:
        at, left = at + k, left + d * k
        if left > sum(min(at, e) * c for e, c in b):
            return False
    return True


def is_split(runs: list[tuple[int, int]]) -> bool:
    """Of a simple graph, by its degrees (Hammer and Simeone): with m the last i whose degree is i - 1 or more, the first m sum to m (m - 1) and the rest."""
    m = at = 0
    for d, k in runs:
        m = max(m, min(at + k, d + 1)) if min(at + k, d + 1) > at else m
        at += k
    first = rest = at = 0
    for d, k in runs:
        inside = max(0, min(k, m - at))
        first, rest, at = first + d * inside, rest + d * (k - inside), at + k
    return first == m * (m - 1) + rest


def is_threshold(runs: list[tuple[int, int]]) -> bool:
    """Of a simple graph, by its degrees: isolated and dominating vertices go, all of a kind at once, until none is left."""
    left, n, gone = [list(r) for r in runs], sum(k for _, k in runs), 0
    while left:
        if left[-1][0] - gone == 0:
            n -= left.pop()[1]
        elif left[0][0] - gone == n - 1:
            k = left.pop(0)[1]
            n, gone = n - k, gone + k
        else:
            return False
    return True


def satisfies_ore(g: Graph, runs: list[tuple[int, int]]) -> bool:
    """Whether every two vertices without an edge have n degrees together: pairs of classes that are too small may have no pair but edges."""
    n = sum(k for _, k in runs)
    if n < 3:
        return False
    e = g.edge_degrees.where("src != dst").where(F.col("du") + F.col("dv") < n).count()
    small, ups = 0, sorted(runs)
    for i, (d, k) in enumerate(ups):
        small += k * (k - 1) // 2 if 2 * d < n else 0
        small += sum(k * c for f, c in ups[i + 1 :] if d + f < n)
    return small == e


def without_leaves(g: Graph) -> Graph:
    """The graph less its vertices of degree 0 and 1."""
    kept = store(g.degrees().where("d > 1").select("v"))
    e = g.edges.join(kept.select(F.col("v").alias("src")), "src", "left_semi").join(kept.select(F.col("v").alias("dst")), "dst", "left_semi")
    return Graph(kept, store(e), g.directed)


def _counts(g: Graph) -> tuple[int, int, int, bool]:
    """n, m, components, whether simple."""
    n, c = connected_components(g).agg(F.count("*"), F.count_distinct("component")).first()
    m, loops, pairs = g.edges.agg(F.count("*"), F.coalesce(F.count_if(F.col("src") == F.col("dst")), F.lit(0)), F.count_distinct("src", "dst")).first()
    return n, m, c, not loops and pairs == m


def _path_like(g: Graph) -> bool:
    """Whether a forest's part is one path, or nothing."""
    runs = degree_classes(g)
    n, m, c, _ = _counts(g)
    return n == 0 or (c == 1 and m == n - 1 and runs[0][0] <= 2)


def undirected_classes(g: Graph) -> DataFrame:
    """(name, value) of the classes that degrees, components, leaves and sides decide."""
    runs = degree_classes(g)
    n, m, c, simple = _counts(g)
    degree = dict(runs)
    top, bottom = (runs[0][0], runs[-1][0]) if runs else (0, 0)
    tree = c == 1 and m == n - 1
    inner = without_leaves(g) if tree else None
    per_part = connected_components(g)
    part_edges = g.edges.join(per_part.withColumnRenamed("v", "src"), "src").groupBy("component").agg(F.count("*").alias("m"))
    parts = store(per_part.groupBy("component").agg(F.count("*").alias("n")).join(part_edges, "component", "left").na.fill(0, ["m"]))
    from lattica.operators.recognise import bipartite_sides, frustrated_edges

    sides = store(bipartite_sides(g).join(g.degrees(), "v"))
    two = frustrated_edges(g, sides.select("v", "side")).isEmpty()
    kinds = sides.groupBy("side").agg(F.count("*").alias("k"), F.min("d").alias("low"), F.max("d").alias("high")).collect()  # two rows
    size = {r.side: r.k for r in kinds}
    found = {
        "is_split_graph": simple and is_split(runs), "is_threshold_graph": simple and is_threshold(runs), "is_spider": tree and sum(k for d, k in runs if d >= 3) <= 1, "is_caterpillar": n <= 1 or (tree and _path_like(inner)),
        "is_lobster": n <= 1 or (tree and _path_like(without_leaves(inner))), "is_pseudo_forest": parts.where("m > n").isEmpty(), "is_wheel": simple and n >= 4 and m == 2 * (n - 1) and (degree == {3: 4} if n == 4 else degree == {n - 1: 1, 3: n - 1}) and c == 1,
        "is_biregular": two and all(r.low == r.high for r in kinds), "is_complete_bipartite": two and simple and c == 1 and n >= 2 and m == size.get(0, 0) * size.get(1, 0), "is_biclique": simple and (n <= 1 or (two and c == 1 and m == size.get(0, 0) * size.get(1, 0))),
        "is_acyclic": m == n - c, "satisfies_dirac": n >= 3 and 2 * bottom >= n, "satisfies_ore": simple and satisfies_ore(g, runs), "is_graphical": is_graphical(runs), "is_regular_graph": top == bottom,
    }
    return g.spark.createDataFrame([(k, bool(v) and not g.directed) for k, v in found.items()], "name string, value boolean")


def strongly_regular_parameters(g: Graph) -> DataFrame:
    """(n, k, lambda, mu) if the simple undirected graph is strongly regular, else no row: common neighbours of neighbours and of others are one number each."""
    runs = degree_classes(g)
    n = sum(k for _, k in runs)
    schema = "n long, k long, lambda long, mu long"
    if len(runs) != 1 or n < 2 or runs[0][0] in (0, n - 1) or g.directed:
        return g.spark.createDataFrame([], schema)
    near = store(g.simple_slots)
    two = near.join(near.select(F.col("v").alias("u"), F.col("u").alias("w")), "u").where("v < w").groupBy("v", "w").agg(F.count("*").alias("x"))
    linked = near.where("v < u").withColumnRenamed("u", "w").withColumn("there", F.lit(1))
    every = two.join(linked, ["v", "w"], "full").groupBy(F.col("there").isNotNull().alias("there")).agg(F.min(F.coalesce("x", F.lit(0))).alias("low"), F.max(F.coalesce("x", F.lit(0))).alias("high"), F.count("*").alias("pairs"))
    got = {r.there: r for r in every.collect()}  # two rows
    apart = n * (n - 1) // 2 - got[True].pairs
    seen = got[False].pairs if False in got else 0
    mu = (got[False].low, got[False].high) if False in got else (0, 0)
    if seen < apart:  # pairs without a common neighbour have no row
        mu = (0, mu[1])
    if got[True].low != got[True].high or mu[0] != mu[1]:
        return g.spark.createDataFrame([], schema)
    return g.spark.createDataFrame([(n, runs[0][0], got[True].low, mu[0])], schema)


def directed_classes(g: Graph) -> DataFrame:
    """(name, value): tournaments have one arc between any two vertices, semicomplete graphs at least one; has_mutual and count_mutual of arcs both ways."""
    n = g.vertices.count()
    arcs = g.edges.where("src != dst").select("src", "dst").distinct()
    pairs = arcs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k"))
    linked, both = pairs.agg(F.count("*"), F.coalesce(F.count_if(F.col("k") == 2), F.lit(0))).first()
    simple = g.edges.count() == linked + both
    every = linked == n * (n - 1) // 2
    rows = [("is_tournament", g.directed and every and not both and simple, 0), ("is_semicomplete", g.directed and every, 0), ("has_mutual", both > 0 if g.directed else linked > 0, both)]
    return g.spark.createDataFrame(rows, "name string, value boolean, mutual long")


def is_geodetic(g: Graph) -> bool:
    """Whether no two vertices have more than one shortest path."""
    from lattica.operators.distances import distances

    return distances(g).where("paths > 1").isEmpty()


def block_classes(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(component, name, value) of each component: whether its blocks are cliques (is_block_graph) or edges and cycles (is_cactus_graph), and the shares of bridges, cut vertices and the largest block."""

    def kernel(vertices, edges):
        near = adjacency(vertices, edges)
        order, low, blocks, cut, stack = {}, {}, [], set(), []
        for root in vertices:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            path, branches = [(root, None, iter(sorted(near[root])))], 0
            while path:
                v, parent, rest = path[-1]
                u = next(rest, None)
                if u is None:
                    path.pop()
                    if path:
                        w = path[-1][0]
                        low[w] = min(low[w], low[v])
                        if low[v] >= order[w]:
                            block = set()
                            while True:
                                e = stack.pop()
                                block.add(e)
                                if e == (w, v):
                                    break
                            blocks.append(block)
                            if w != root:
                                cut.add(w)
                            else:
                                branches += 1
                elif u == parent:
                    continue
                elif u not in order:
                    order[u] = low[u] = len(order)
                    stack.append((v, u))
                    path.append((u, v, iter(sorted(near[u]))))
                elif order[u] < order[v]:
                    stack.append((v, u))
                    low[v] = min(low[v], order[u])
            if branches > 1:
                cut.add(root)
        sizes = [(len({x for e in b for x in e}), len(b)) for b in blocks]
        m = max(1, sum(k for _, k in sizes))
        facts = {
            "is_block_graph": all(k == n * (n - 1) // 2 for n, k in sizes), "is_cactus_graph": all(k == 1 or k == n for n, k in sizes), "is_biconnected": len(vertices) > 1 and len(blocks) == 1, "bridge_ratio": sum(k == 1 for _, k in sizes) / m,
            "bridge_edge_ratio": sum(k == 1 for _, k in sizes) / m, "articulation_ratio": len(cut) / len(vertices) if len(vertices) > 2 else 0.0, "biconnected_ratio": max((k for _, k in sizes), default=0) / m,
        }
        yield from ((vertices[0], name, float(x)) for name, x in facts.items())

    return per_component(g, kernel, "component long, name string, value double", most_edges)


def _rest_is_forest(near: dict[int, set[int]], gone: int) -> tuple[bool, int]:
    """Whether the graph without a vertex has no cycle, and its components."""
    seen, parts = {gone}, 0
    for v in near:
        if v in seen:
            continue
        parts += 1
        seen.add(v)
        todo = [(v, None)]
        while todo:
            x, parent = todo.pop()
            for y in near[x]:
                if y == gone or y == parent:
                    continue
                if y in seen:
                    return False, parts
                seen.add(y)
                todo.append((y, x))
    return True, parts


def apex_classes(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(component, name, value): whether some vertex's removal leaves a forest, or a tree."""

    def kernel(vertices, edges):
        near = adjacency(vertices, edges)
        left = [_rest_is_forest(near, v) for v in vertices] if len(edges) < 2 * len(vertices) + max((len(x) for x in near.values()), default=0) else []
        yield vertices[0], "is_apex_forest", any(ok for ok, _ in left)
        yield vertices[0], "is_apex_tree", any(ok and parts <= 1 for ok, parts in left)

    return per_component(g, kernel, "component long, name string, value boolean", most_edges)


def width_bounds(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(component, name, value): upper bounds on treewidth by eliminating the vertex of least degree, or of least fill, ties to the least; series-parallel and outerplanar follow from widths of 2."""

    def kernel(vertices, edges):
        for name, by_fill in (("treewidth_upper_bound", False), ("treewidth_min_fill", True)):
            near, width = {v: set(x) for v, x in adjacency(vertices, edges).items()}, 0
            missing = lambda v: sum(b not in near[a] for a in near[v] for b in near[v] if a < b)
            while near:
                v = min(near, key=lambda x: (missing(x) if by_fill else len(near[x]), x))
                around = near.pop(v)
                width = max(width, len(around))
                for a in around:
                    near[a] |= around - {a}
                    near[a].discard(v)
            yield vertices[0], name, width
            if not by_fill:
                yield vertices[0], "is_series_parallel", int(width <= 2)

    return per_component(g, kernel, "component long, name string, value long", most_edges)


def elimination_ordering(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(v, i): vertices in the order in which the one of least degree, ties to the least, is eliminated and its neighbours are joined."""

    def kernel(vertices, edges):
        near, i = {v: set(x) for v, x in adjacency(vertices, edges).items()}, 0
        while near:
            v = min(near, key=lambda x: (len(near[x]), x))
            around = near.pop(v)
            for a in around:
                near[a] |= around - {a}
                near[a].discard(v)
            yield v, i
            i += 1

    return per_component(g, kernel, "v long, i long", most_edges)
