"""Sequential or NP-hard algorithms, one connected component a task.

A component is gathered into one task only here, and only up to a stated number of edges: a larger one
is an error, never a sample.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.iterate import connected_components
from lattica.operators.twins import merged
from lattica.shipping import ship

Adjacency = dict[int, set[int]]


def per_component(g: Graph, kernel: Callable[..., Iterator[tuple]], schema: str, most_edges: int = 200_000, weighted: bool = False) -> DataFrame:
    """Rows of ``kernel(vertices, edges)``, edges being (eid, src, dst) in the order of eid, for each weak component; if ``weighted``, of ``kernel(vertices, edges, sizes, copies)`` with the size of a vertex and the k of an edge."""
    ship(g.spark)
    c = store(connected_components(g))
    at = c.join(g.vertices.select("v", F.col("size").alias("w")), "v") if weighted else c.withColumn("w", F.lit(1).cast("long"))
    rows = at.select("component", F.col("v").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("eid"), "w")
    k = F.col("k") if weighted else F.lit(1).cast("long")
    rows = rows.unionByName(g.edges.join(c.withColumnRenamed("v", "src"), "src").select("component", F.col("src").alias("a"), F.col("dst").alias("b"), "eid", k.alias("w")))
    names = [x.split()[0] for x in schema.split(", ")]
    largest = rows.groupBy("component").agg(F.count("b").alias("m")).agg(F.max("m")).first()[0] or 0
    if largest > most_edges:  # before anything is gathered
        raise ValueError(f"a component has {largest} edges; this kernel takes {most_edges}")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        e = part[part.b.notna()].sort_values("eid")
        vertices = part[part.b.isna()].sort_values("a")
        more = (list(vertices.w.astype(int)), list(e.w.astype(int))) if weighted else ()
        return pd.DataFrame(list(kernel(list(vertices.a.astype(int)), list(zip(e.eid.astype(int), e.a.astype(int), e.b.astype(int))), *more)), columns=names)

    return rows.groupBy("component").applyInPandas(run, schema)


def adjacency(vertices: list[int], edges: list[tuple[int, int, int]]) -> Adjacency:
    out: Adjacency = {v: set() for v in vertices}
    for _, a, b in edges:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def _laplacian(vertices: list[int], edges: list[tuple[int, int, int]], sizes: list[int], copies: list[int]) -> np.ndarray:
    """On the vectors that are even over each class of twins, in an orthonormal basis; the others in a class have its degree as eigenvalue, and 0 in the adjacency matrix."""
    at = {v: i for i, v in enumerate(vertices)}
    m = np.zeros((len(vertices), len(vertices)))
    for (_, a, b), k in zip(edges, copies):
        if a != b:
            i, j = at[a], at[b]
            m[i, j] -= k * np.sqrt(float(sizes[i]) * sizes[j])
            m[j, i] = m[i, j]
            m[i, i] += k * sizes[j]
            m[j, j] += k * sizes[i]
    return m


def spectra(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(component, n, i, adjacency, laplacian): both spectra of each component, ascending; ``most_edges`` bounds them once twins are merged."""

    def kernel(vertices, edges, sizes, copies):
        lap = _laplacian(vertices, edges, sizes, copies)
        more, degrees = np.array(sizes) - 1, np.diag(lap)
        adj = np.sort(np.concatenate([np.linalg.eigvalsh(np.diag(degrees) - lap), np.zeros(more.sum())]))
        both = np.sort(np.concatenate([np.linalg.eigvalsh(lap), np.repeat(degrees, more)]))
        for i, (x, y) in enumerate(zip(adj, both)):
            yield vertices[0], len(adj), i, float(x), float(y)

    return per_component(merged(g)[0], kernel, "component long, n long, i long, adjacency double, laplacian double", most_edges, True)


def spectral_measures(g: Graph) -> DataFrame:
    """(component, name, value): algebraic_connectivity, spanning_tree_count, kirchhoff_index, graph_energy, laplacian_energy (distances of its eigenvalues from their mean), estrada_index, natural_connectivity, spectral_radius of each component."""
    s = spectra(g).withColumn("mean", F.avg("laplacian").over(Window.partitionBy("component")))  # a kernel held the component
    t = s.groupBy("component").agg(
        F.max(F.expr("case when i = 1 then laplacian end")).alias("algebraic_connectivity"), F.exp(F.coalesce(F.sum(F.expr("case when i > 0 then ln(laplacian) end")), F.lit(0.0)) - F.log(F.max("n"))).alias("spanning_tree_count"),
        (F.max("n") * F.coalesce(F.sum(F.expr("case when i > 0 then 1 / laplacian end")), F.lit(0.0))).alias("kirchhoff_index"), F.sum(F.abs("adjacency")).alias("graph_energy"), F.sum(F.abs(F.col("laplacian") - F.col("mean"))).alias("laplacian_energy"), F.sum(F.exp("adjacency")).alias("estrada_index"),
        F.log(F.avg(F.exp("adjacency"))).alias("natural_connectivity"), F.max("adjacency").alias("spectral_radius"),
    )
    names = t.columns[1:]
    return t.select("component", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("p")).select("component", "p.*")


def fiedler(g: Graph) -> DataFrame:
    """(v, value, side): the second Laplacian eigenvector of each component, and the bisection by its sign. Found with twins merged; if it is one of a class of twins, it has the least two of them on its sides."""

    def kernel(vertices, edges, sizes, copies):
        lap, many = _laplacian(vertices, edges, sizes, copies), np.array(sizes)
        values, vectors = np.linalg.eigh(lap)
        within = np.where(many > 1, np.diag(lap), np.inf)
        if within.min() < (values[1] * (1 - 1e-9) if len(values) > 1 else np.inf):
            at = int(within.argmin())
            for i, v in enumerate(vertices):
                yield v, 0.0, i == at
            return
        vec = vectors[:, min(1, len(vertices) - 1)] / np.sqrt(many)
        vec = vec * (1 if vec[np.argmax(np.abs(vec))] > 0 else -1)
        for v, x in zip(vertices, vec):
            yield v, float(x), False

    q, classes = merged(g)
    found = store(per_component(q, kernel, "c long, value double, within boolean", 20_000, True)).join(classes, "c")
    first = found.where("within").withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("v"))).select("v", F.expr("case i when 1 then sqrt(0.5D) when 2 then -sqrt(0.5D) else 0.0D end").alias("value"))
    return found.where("not within").select("v", "value").unionByName(first).select("v", "value", F.when(F.col("value") < 0, 1).otherwise(0).cast("long").alias("side"))


def maximal_cliques(g: Graph) -> DataFrame:
    """(clique): every maximal clique, its vertices ascending, by Bron and Kerbosch with pivots."""

    def kernel(vertices, edges):
        near = adjacency(vertices, edges)
        stack = [(frozenset(), set(vertices), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                yield (sorted(r),)
                continue
            if not p:
                continue
            pivot = max(p | x, key=lambda v: len(near[v] & p))
            for v in list(p - near[pivot]):
                stack.append((r | {v}, p & near[v], x & near[v]))
                p.discard(v)
                x.add(v)

    return per_component(g, kernel, "clique array<long>")


def cut_points(g: Graph) -> DataFrame:
    """(kind, id, block): articulation points (id a vertex), bridges (id an edge), and the biconnected block of each edge."""

    def kernel(vertices, edges):
        slots = defaultdict(list)
        for e, a, b in edges:
            if a != b:
                slots[a].append((b, e))
                slots[b].append((a, e))
        order, low, cut, blocks = {}, {}, set(), 0
        for root in vertices:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack, held, below_root = [(root, None, iter(slots[root]))], [], 0
            while stack:
                v, via, rest = stack[-1]
                for u, e in rest:
                    if e == via:
                        continue
                    if u not in order:
                        held.append(e)
                        order[u] = low[u] = len(order)
                        stack.append((u, e, iter(slots[u])))
                        break
                    if order[u] < order[v]:
                        held.append(e)
                        low[v] = min(low[v], order[u])
                else:
                    stack.pop()
                    if stack:
                        p = stack[-1][0]
                        low[p] = min(low[p], low[v])
                        if low[v] >= order[p]:
                            below_root += p == root
                            if p != root:
                                cut.add(p)
                            block = [held.pop()]
                            while block[-1] != via:
                                block.append(held.pop())
                            for e in block:
                                yield "edge", e, vertices[0] * 1_000_000 + blocks
                            if len(block) == 1:
                                yield "bridge", via, None
                            blocks += 1
            if below_root > 1:
                cut.add(root)
        for v in sorted(cut):
            yield "articulation", v, None

    return per_component(g, kernel, "kind string, id long, block long")


def greedy_coloring(g: Graph) -> DataFrame:
    """(v, color): DSatur; ties to the larger degree, then the lesser id."""

    def kernel(vertices, edges):
        near, color = adjacency(vertices, edges), {}
        seen: dict[int, set] = {v: set() for v in vertices}
        left = set(vertices)
        while left:
            v = max(left, key=lambda x: (len(seen[x]), len(near[x]), -x))
            left.discard(v)
            color[v] = next(c for c in range(len(vertices)) if c not in seen[v])
            for u in near[v]:
                seen[u].add(color[v])
            yield v, color[v]

    return per_component(g, kernel, "v long, color long")


def is_chordal(g: Graph) -> DataFrame:
    """(component, chordal): by maximum cardinality search."""

    def kernel(vertices, edges):
        near, weight, done, ok = adjacency(vertices, edges), dict.fromkeys(vertices, 0), [], True
        place: dict[int, int] = {}
        left = set(vertices)
        while left:
            v = max(left, key=lambda x: (weight[x], -x))
            left.discard(v)
            earlier = [u for u in near[v] if u in place]
            if earlier:
                last = max(earlier, key=place.get)
                ok &= all(u == last or u in near[last] for u in earlier)
            place[v] = len(place)
            done.append(v)
            for u in near[v] & left:
                weight[u] += 1
        yield vertices[0], bool(ok)

    return per_component(g, kernel, "component long, chordal boolean")


def girth(g: Graph) -> DataFrame:
    """(component, girth): the shortest cycle of the simple graph, null without one."""

    def kernel(vertices, edges):
        near, best = adjacency(vertices, edges), None

        def drop(ends):
            """Vertices on no cycle go: those given, if they have one neighbour or none left, and those that come to it."""
            while ends:
                v = ends.pop()
                if v in near and len(near[v]) <= 1:
                    for u in near.pop(v):
                        near[u].discard(v)
                        ends.append(u)

        drop(list(vertices))
        for root in vertices:
            if root not in near:
                continue
            dist, parent, queue = {root: 0}, {root: None}, deque([root])
            while queue:
                v = queue.popleft()
                if best is not None and 2 * dist[v] + 1 >= best:
                    break
                for u in near[v]:
                    if u not in dist:
                        dist[u], parent[u] = dist[v] + 1, v
                        queue.append(u)
                    elif parent[v] != u:
                        best = min(best or 1 << 60, dist[u] + dist[v] + 1)
            around = list(near.pop(root))  # its cycles are known
            for u in around:
                near[u].discard(root)
            drop(around)
        yield vertices[0], best

    return per_component(g, kernel, "component long, girth long")


def max_flow(edges: list[tuple[int, int, float]], source: int, target: int, directed: bool = True) -> tuple[float, set[int]]:
    """Value of a maximum flow and the source's side of a least cut, by Dinic's levels."""
    if source == target:
        raise ValueError("source and target must differ")
    head, cap, out = [], [], defaultdict(list)
    for a, b, c in edges:
        for x, y, k in ((a, b, c), (b, a, 0.0 if directed else c)):
            out[x].append(len(head))
            head.append(y)
            cap.append(k)
    total = 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for i in out[v]:
                if cap[i] > 0 and head[i] not in level:
                    level[head[i]] = level[v] + 1
                    queue.append(head[i])
        if target not in level:
            return total, set(level)
        rest = {v: iter(out[v]) for v in level}
        path: list[int] = []
        v = source
        while True:
            if v == target:
                push = min(cap[i] for i in path)
                total += push
                for i in path:
                    cap[i] -= push
                    cap[i ^ 1] += push
                path, v = [], source
                continue
            for i in rest[v]:
                if cap[i] > 0 and level.get(head[i]) == level[v] + 1:
                    path.append(i)
                    v = head[i]
                    break
            else:
                if not path:
                    break
                level.pop(v)
                v = head[path.pop() ^ 1]


def st_flows(g: Graph, pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """(s, t, value): a maximum flow for each pair (s, t), pairs in parallel; unit capacities without ``weight``. The edges go to every worker: at most a million."""
    e = g.edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).limit(1_000_001).collect()
    if len(e) > 1_000_000:
        raise ValueError("flows take graphs of at most a million edges")
    ship(g.spark)
    sent, directed = g.spark.sparkContext.broadcast([(r.src, r.dst, r.w) for r in e]), g.directed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(value=[max_flow(sent.value, s, t, directed)[0] for s, t in zip(p.s, p.t)])

    return pairs.select("s", "t").mapInPandas(run, "s long, t long, value double")


def bipartite_matching(g: Graph) -> DataFrame:
    """(a, b): a maximum matching of each bipartite component, by augmenting paths from the lesser side; an odd cycle is an error."""

    def kernel(vertices, edges):
        near, side = adjacency(vertices, edges), {}
        for root in vertices:
            if root not in side:
                side[root], queue = 0, deque([root])
                while queue:
                    v = queue.popleft()
                    for u in near[v]:
                        if u not in side:
                            side[u] = 1 - side[v]
                            queue.append(u)
                        elif side[u] == side[v]:
                            raise ValueError("the graph isn't bipartite")
        mate: dict[int, int] = {}
        for root in (v for v in vertices if side[v] == 0):
            parent, queue, end = {root: None}, deque([root]), None
            seen = set()
            while queue and end is None:
                v = queue.popleft()
                for u in sorted(near[v] - seen):
                    seen.add(u)
                    parent[u] = v
                    if u not in mate:
                        end = u
                        break
                    parent[mate[u]] = u
                    queue.append(mate[u])
            while end is not None:
                v = parent[end]
                nxt = mate.get(v)
                mate[end], mate[v] = v, end
                end = nxt if v != root else None
        yield from sorted((v, mate[v]) for v in vertices if side[v] == 0 and v in mate)

    return per_component(g, kernel, "a long, b long")
