"""Flows, cuts and connectivity: pairs of ends in parallel, each flow a kernel over the edges; cuts of a whole graph from flows between few pairs."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.kernels import max_flow, per_component, st_flows
from lattica.operators.paths import even_tarjan_reduction
from lattica.shipping import ship


def st_mincuts(g: Graph, pairs: DataFrame, weight: str | None = None, most_edges: int = 1_000_000) -> DataFrame:
    """(s, t, value, side): a least cut for each pair and the vertices on the side of s. The edges go to every worker, ``most_edges`` at most."""
    if g.edges.count() > most_edges:
        raise ValueError(f"cuts take graphs of at most {most_edges} edges")
    ship(g.spark)
    rows = g.edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).collect()
    sent, directed = g.spark.sparkContext.broadcast([(r.src, r.dst, r.w) for r in rows]), g.directed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [max_flow(sent.value, s, t, directed) for s, t in zip(p.s, p.t)]
            yield p.assign(value=[x for x, _ in found], side=[sorted(x) for _, x in found])

    return pairs.select("s", "t").mapInPandas(run, "s long, t long, value double, side array<long>")


def _from_one(g: Graph) -> DataFrame:
    """(s, t): the least vertex with every other, and back if the graph is directed: some of these a global cut parts."""
    least = g.vertices.agg(F.min("v").alias("s"))
    pairs = g.vertices.select(F.col("v").alias("t")).crossJoin(F.broadcast(least)).where("s != t").select("s", "t")  # one row
    return pairs.unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t"))) if g.directed else pairs


def mincut_value(g: Graph, weight: str | None = None) -> float:
    """The least weight that parts the graph; 0 if it isn't connected."""
    return float(st_flows(g, _from_one(g), weight).agg(F.min("value")).first()[0] or 0.0)


def mincut(g: Graph, weight: str | None = None) -> tuple[float, DataFrame, DataFrame]:
    """The value, the vertices (v) of one side, and the edges (eid) cut."""
    cut = store(st_mincuts(g, _from_one(g), weight).orderBy("value", "s", "t").limit(1))
    side = store(cut.select(F.explode("side").alias("v")))
    inside = side.withColumn("x", F.lit(True))
    e = g.edges.select("eid", "src", "dst").join(inside.select(F.col("v").alias("src"), F.col("x").alias("a")), "src", "left").join(inside.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst", "left")
    crossing = "a is not null and b is null" if g.directed else "(a is null) != (b is null)"
    return float(cut.first().value), side, e.where(crossing).select("eid")


def edge_connectivity(g: Graph) -> int:
    """Edges that must go to part the graph."""
    return int(mincut_value(g))


def _split(g: Graph) -> Graph:
    h = even_tarjan_reduction(g) if not g.directed else None
    if h is not None:
        return h
    n = g.vertices.count()
    inner = g.vertices.select((2 * F.col("v")).alias("src"), (2 * F.col("v") + 1).alias("dst"), F.lit(1.0).alias("capacity"))
    outer = g.edges.select((2 * F.col("src") + 1).alias("src"), (2 * F.col("dst")).alias("dst"), F.lit(float(n)).alias("capacity"))
    return Graph.from_edges(inner.unionByName(outer), True)


def st_vertex_connectivity(g: Graph, pairs: DataFrame) -> DataFrame:
    """(s, t, value): vertices that must go to part s from t, for pairs without an edge; also the number of paths that share no inner vertex."""
    h = _split(g)
    flows = st_flows(h, pairs.select((2 * F.col("s") + 1).alias("s"), (2 * F.col("t")).alias("t")), "capacity")
    return flows.select(F.expr("(s - 1) div 2").alias("s"), F.expr("t div 2").alias("t"), F.col("value").cast("long").alias("value"))


def vertex_connectivity(g: Graph) -> int:
    """Vertices that must go to part an undirected graph, n - 1 if it is complete.

    Either a least separator leaves out a vertex v of least degree, and parts it from some vertex, or it has v, which
    then has neighbours on both sides: so the pairs of v with others, and of its neighbours, are enough.
    """
    near = store(g.simple_slots)
    d = store(near.groupBy("v").agg(F.count("*").alias("d")))
    n = g.vertices.count()
    if d.count() < n:
        return 0
    v = d.orderBy("d", "v").first().v
    around = near.where(F.col("v") == v).select("u")
    one = g.vertices.select(F.lit(v).alias("s"), F.col("v").alias("t"))
    two = around.select(F.col("u").alias("s")).join(around.select(F.col("u").alias("t")), F.col("s") < F.col("t"))
    pairs = store(one.unionByName(two).where("s != t").join(near.select(F.col("v").alias("s"), F.col("u").alias("t")), ["s", "t"], "left_anti"))
    least = st_vertex_connectivity(g, pairs).agg(F.min("value")).first()[0]
    return n - 1 if least is None else int(least)


def is_separator(g: Graph, vertices: DataFrame) -> bool:
    """Whether the rest of the graph isn't connected, without ``vertices`` (v)."""
    from lattica.operators.iterate import connected_components

    gone = vertices.select("v").distinct()
    rest = g.vertices.join(gone, "v", "left_anti")
    e = g.edges.join(gone.select(F.col("v").alias("src")), "src", "left_anti").join(gone.select(F.col("v").alias("dst")), "dst", "left_anti")
    return (connected_components(Graph(rest, e)).agg(F.count_distinct("component")).first()[0] or 0) > 1


def is_minimal_separator(g: Graph, vertices: DataFrame) -> bool:
    """Whether it is a separator and no longer one without any of its vertices."""
    held = [r.v for r in vertices.select("v").distinct().collect()]  # the set that is asked about
    return is_separator(g, vertices) and not any(is_separator(g, vertices.where(F.col("v") != v)) for v in held)


def gomory_hu_tree(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(v, parent, flow): a tree in which the least edge on the way between two vertices is their maximum flow (Gusfield); unit capacities, undirected."""

    def kernel(vertices, edges):
        capacities = [(a, b, 1.0) for _, a, b in edges if a != b]
        parent = dict.fromkeys(vertices[1:], vertices[0])
        for i, v in enumerate(vertices[1:], 1):
            value, side = max_flow(capacities, v, parent[v], False)
            for u in vertices[i + 1 :]:
                if u in side and parent[u] == parent[v]:
                    parent[u] = v
            yield v, parent[v], value

    return per_component(g, kernel, "v long, parent long, flow double", most_edges)


def dominator_tree(g: Graph, root: int, most_edges: int = 1_000_000) -> DataFrame:
    """(v, dominator): the last vertex that every path from the root to v takes before v; null for the root, vertices out of reach have no row."""

    def kernel(vertices, edges):
        if root not in set(vertices):
            return
        out, into = defaultdict(list), defaultdict(list)
        for _, a, b in edges:
            out[a].append(b)
            into[b].append(a)
        number, order, stack = {root: 0}, [], [(root, iter(sorted(out[root])))]
        while stack:
            v, rest = stack[-1]
            u = next(rest, None)
            if u is None:
                order.append(v)
                stack.pop()
            elif u not in number:
                number[u] = len(number)
                stack.append((u, iter(sorted(out[u]))))
        rank = {v: i for i, v in enumerate(order)}  # in the order they are left
        idom, changed = {root: root}, True
        while changed:
            changed = False
            for v in reversed(order[:-1]):
                new = None
                for p in into[v]:
                    if p in idom:
                        if new is None:
                            new = p
                        else:
                            a, b = p, new
                            while a != b:
                                while rank[a] < rank[b]:
                                    a = idom[a]
                                while rank[b] < rank[a]:
                                    b = idom[b]
                            new = a
                if idom.get(v) != new:
                    idom[v], changed = new, True
        yield from ((v, None if v == root else idom[v]) for v in sorted(idom))

    return per_component(g, kernel, "v long, dominator long", most_edges)


def random_spanning_tree(g: Graph, seed: int = 0, most_edges: int = 1_000_000) -> DataFrame:
    """(eid): a spanning tree of each component, each equally likely, by walks without their loops (Wilson)."""
    import numpy as np

    def kernel(vertices, edges):
        rng, near = np.random.Generator(np.random.PCG64([seed, vertices[0] & 0xFFFFFFFF])), defaultdict(list)
        for eid, a, b in edges:
            if a != b:
                near[a].append((b, eid))
                near[b].append((a, eid))
        inside = {vertices[0]}
        for v in vertices:
            step, x = {}, v
            while x not in inside:
                step[x] = near[x][int(rng.integers(len(near[x])))]
                x = step[x][0]
            x = v
            while x not in inside:
                inside.add(x)
                yield (step[x][1],)
                x = step[x][0]

    return per_component(g, kernel, "eid long", most_edges)


def percolation(g: Graph, order: DataFrame, by_vertices: bool = False, most_edges: int = 1_000_000) -> DataFrame:
    """(i, giant, vertices): the largest component's size, and how many vertices are in, after each edge of ``order`` (eid, i), or each vertex (v, i) with its edges to those before; in one task, by union and find."""
    if g.edges.count() > most_edges:
        raise ValueError(f"percolation takes at most {most_edges} edges")
    if by_vertices:
        n = order.select("v", "i")
        e = g.edges.select("src", "dst").join(n.select(F.col("v").alias("src"), F.col("i").alias("x")), "src").join(n.select(F.col("v").alias("dst"), F.col("i").alias("y")), "dst")
        rows = e.select(F.greatest("x", "y").alias("i"), "src", "dst").unionByName(n.select("i", F.col("v").alias("src"), F.col("v").alias("dst")))
    else:
        rows = order.join(g.edges.select("eid", "src", "dst"), "eid").select("i", "src", "dst")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        up: dict[int, int] = {}
        size: dict[int, int] = {}
        giant, out = 0, []

        def find(x: int) -> int:
            if x not in up:
                up[x], size[x] = x, 1
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, group in part.sort_values("i", kind="stable").groupby("i", sort=True):
            for a, b in zip(group.src, group.dst):
                x, y = find(int(a)), find(int(b))
                if x != y:
                    up[x] = y
                    size[y] += size.pop(x)
                giant = max(giant, size[y])
            out.append((int(i), giant, len(up)))
        return pd.DataFrame(out, columns=["i", "giant", "vertices"])

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "i long, giant long, vertices long")


def sir(g: Graph, beta: float, gamma: float, runs: int, seed: int = 0, most_edges: int = 200_000) -> DataFrame:
    """(component, run, time, s, i, r): epidemics from one drawn vertex of each component, event by event, until nobody is infected."""
    import numpy as np

    def kernel(vertices, edges):
        near = defaultdict(set)
        for _, a, b in edges:
            if a != b:
                near[a].add(b)
                near[b].add(a)
        for k in range(runs):
            rng = np.random.Generator(np.random.PCG64([seed, k, vertices[0] & 0xFFFFFFFF]))
            sick, well, time = {vertices[int(rng.integers(len(vertices)))]}, set(vertices), 0.0
            well -= sick
            yield vertices[0], k, time, len(well), len(sick), 0
            while sick:
                risk = sorted((v, u) for v in sick for u in near[v] & well)
                rate = beta * len(risk) + gamma * len(sick)
                time += float(rng.exponential(1 / rate))
                if rng.random() * rate < beta * len(risk):
                    u = risk[int(rng.integers(len(risk)))][1]
                    well.discard(u)
                    sick.add(u)
                else:
                    sick.discard(sorted(sick)[int(rng.integers(len(sick)))])
                yield vertices[0], k, time, len(well), len(sick), len(vertices) - len(well) - len(sick)

    return per_component(g, kernel, "component long, run long, time double, s long, i long, r long", most_edges)


def find_cycle(g: Graph, most_edges: int = 1_000_000) -> DataFrame:
    """(component, cycle): the vertices of some cycle of each component that has one, from its least; directed cycles of a directed graph."""
    directed = g.directed

    def kernel(vertices, edges):
        out = defaultdict(list)
        for eid, a, b in edges:
            out[a].append((b, eid))
            if not directed and a != b:
                out[b].append((a, eid))
        state: dict[int, int] = {}
        for root in vertices:
            if root in state:
                continue
            state[root], path, stack = 1, [root], [(None, iter(sorted(out[root])))]
            while stack:
                via, rest = stack[-1]
                step = next(((u, e) for u, e in rest if directed or e != via), None)
                if step is None:
                    state[path.pop()] = 2
                    stack.pop()
                elif state.get(step[0]) == 1:
                    cycle = path[path.index(step[0]) :]
                    k = cycle.index(min(cycle))
                    yield vertices[0], cycle[k:] + cycle[:k]
                    return
                elif step[0] not in state:
                    state[step[0]] = 1
                    path.append(step[0])
                    stack.append((step[1], iter(sorted(out[step[0]]))))

    return per_component(g, kernel, "component long, cycle array<long>", most_edges)


def feedback_arc_set(g: Graph, most_edges: int = 200_000) -> DataFrame:
    """(eid): arcs whose removal leaves no directed cycle, by the order of Eades, Lin and Smyth: sinks last, sources first, else the vertex with most arcs out over in."""

    def kernel(vertices, edges):
        out, into = {v: defaultdict(int) for v in vertices}, {v: defaultdict(int) for v in vertices}
        for _, a, b in edges:
            if a != b:
                out[a][b] += 1
                into[b][a] += 1
        outs, ins = {v: sum(out[v].values()) for v in vertices}, {v: sum(into[v].values()) for v in vertices}
        left, first, last = set(vertices), [], deque()
        while left:
            sinks, sources = [v for v in left if not outs[v]], [v for v in left if not ins[v]]
            v = min(sinks) if sinks else min(sources) if sources else max(left, key=lambda x: (outs[x] - ins[x], -x))
            if sinks:
                last.appendleft(v)
            else:
                first.append(v)
            left.discard(v)
            for u, k in out[v].items():
                ins[u] -= k
            for u, k in into[v].items():
                outs[u] -= k
        place = {v: i for i, v in enumerate([*first, *last])}
        yield from ((eid,) for eid, a, b in edges if place[a] >= place[b])

    return per_component(g, kernel, "eid long", most_edges)
