"""Communities: modularity and its optimization by rounds of joins, and sequential methods a component at a time.

Louvain and Leiden run as tables: in a round, the vertices of one half (by a hash of vertex and round) move to
the neighbouring community that gains most, all at once; halves keep neighbours from swapping for ever. What
doesn't raise modularity is taken back. The kernels gather a component into one task, up to a stated size.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.iterate import connected_components
from lattica.operators.kernels import per_component


def modularity(g: Graph, labels: DataFrame, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(modularity) of (v, label), directed or not; loops count twice in an undirected volume; null without edges."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = g.edges.select("src", "dst", w.alias("w")).join(labels.select(F.col("v").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("v").alias("dst"), F.col("label").alias("y")), "dst")
    inside = e.where("x = y").groupBy(F.col("x").alias("label")).agg(F.sum("w").alias("inside"))
    out, into = e.groupBy(F.col("x").alias("label")).agg(F.sum("w").alias("o")), e.groupBy(F.col("y").alias("label")).agg(F.sum("w").alias("i"))
    c = labels.select("label").distinct().join(inside, "label", "left").join(out, "label", "left").join(into, "label", "left").na.fill(0.0)
    total = e.agg(F.sum("w").alias("m"))
    expected = "o * i / (m * m)" if g.directed else "(o + i) * (o + i) / (4 * m * m)"
    return c.crossJoin(F.broadcast(total)).agg(real(F.expr(f"sum(inside / m - {resolution}D * {expected})")).alias("modularity"))  # one row


def modularity_matrix(g: Graph, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(v, u, b): what is between two vertices less what their strengths make one expect; n squared rows by its nature."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    slots = g.slots.select("v", "u", w.alias("w")).groupBy("v", "u").agg(F.sum("w").alias("w"))
    out, into = slots.groupBy("v").agg(F.sum("w").alias("o")), slots.groupBy("u").agg(F.sum("w").alias("i"))
    x = g.vertices.select("v").join(out, "v", "left").na.fill(0.0)
    y = g.vertices.select(F.col("v").alias("u")).join(into, "u", "left").na.fill(0.0)
    total = slots.agg(F.sum("w").alias("m"))
    pairs = x.crossJoin(y).crossJoin(F.broadcast(total)).join(slots, ["v", "u"], "left")  # all pairs: the matrix is what is asked for
    return pairs.select("v", "u", real(F.expr(f"coalesce(w, 0) - {resolution}D * o * i / m")).alias("b"))


def _moved(edges: DataFrame, strength: DataFrame, state: DataFrame, total: float, turn: int, resolution: float) -> DataFrame:
    """(v, c) after the vertices of one half have moved."""
    known = state.join(strength, "v")
    volume = known.groupBy("c").agg(F.sum("k").alias("vol"))
    links = edges.where("v != u").join(state.select(F.col("v").alias("u"), "c"), "u").groupBy("v", "c").agg(F.sum("w").alias("w"))
    own = known.select("v", "c", F.lit(0.0).alias("w"))  # staying is a choice without links too
    choices = links.unionByName(own).groupBy("v", "c").agg(F.sum("w").alias("w")).join(known.select("v", F.col("c").alias("now"), "k"), "v").join(volume, "c")
    gain = F.col("w") - resolution * F.col("k") * (F.col("vol") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) / total
    best = choices.withColumn("gain", gain).groupBy("v", "now").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("b"), F.max(F.expr("case when c = now then gain end")).alias("stay"))
    may = F.pmod(F.xxhash64("v", F.lit(turn // 2)), F.lit(2)) == turn % 2
    return best.select("v", F.when(may & (F.col("b.gain") > F.col("stay") + 1e-12), -F.col("b.c")).otherwise(F.col("now")).alias("c"))


def louvain(g: Graph, weight: str | None = None, resolution: float = 1.0, connected: bool = False, patience: int = 2, most_rounds: int = 50) -> DataFrame:
    """(v, community): Louvain's method in rounds of moves; a community is called by its least vertex. Undirected graphs.

    Levels of moving and merging go on until no merge is left. ``connected``: a community that has come apart is split
    before it is merged, as in Leiden's method, whose result it then shares: communities are connected.
    """
    if g.directed:
        raise ValueError("undirected graphs only")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    edges = store(g.slots.select("v", "u", w.alias("w")).groupBy("v", "u").agg(F.sum("w").alias("w")))
    total = edges.agg(F.sum("w")).first()[0] or 0.0
    member = store(g.vertices.select("v", F.col("v").alias("c")))
    if total == 0:
        return member.withColumnRenamed("c", "community")
    while True:
        strength = store(edges.groupBy("v").agg(F.sum("w").alias("k")))
        state = store(strength.select("v", F.col("v").alias("c")))

        def score(s: DataFrame) -> float:
            inside = edges.join(s, "v").join(s.select(F.col("v").alias("u"), F.col("c").alias("d")), "u").where("c = d").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("x"))
            volumes = strength.join(s, "v").groupBy("c").agg(F.sum("k").alias("vol")).agg(F.sum(F.expr("vol * vol")).alias("y"))
            x, y = inside.crossJoin(volumes).first()  # one row each
            return x / total - resolution * y / (total * total)

        best, quality, worse = state, score(state), 0
        for turn in range(most_rounds):
            state = store(_moved(edges, strength, state, total, turn, resolution))
            now = score(state)
            if now > quality + 1e-9:
                best, quality, worse = state, now, 0
            else:
                worse += 1
                if worse >= 2 * patience:
                    break
        if connected:
            within = edges.where("v != u").join(best, "v").join(best.select(F.col("v").alias("u"), F.col("c").alias("d")), "u").where("c = d").select(F.col("v").alias("src"), F.col("u").alias("dst"))
            best = store(connected_components(Graph(strength.select("v"), within)).withColumnRenamed("component", "c"))
        else:
            least = best.groupBy("c").agg(F.min("v").alias("name"))
            best = store(best.join(least, "c").select("v", F.col("name").alias("c")))
        if best.where("v != c").isEmpty():
            break
        member = store(member.withColumnRenamed("c", "old").join(best.withColumnRenamed("v", "old"), "old", "left").select("v", F.coalesce("c", "old").alias("c")))
        edges = store(edges.join(best, "v").join(best.select(F.col("v").alias("u"), F.col("c").alias("d")), "u").groupBy(F.col("c").alias("v"), F.col("d").alias("u")).agg(F.sum("w").alias("w")))
    least = member.groupBy("c").agg(F.min("v").alias("community"))
    return member.join(least, "c").select("v", "community")


def leiden(g: Graph, weight: str | None = None, resolution: float = 1.0) -> DataFrame:
    """(v, community): as louvain(), with communities split into their connected parts at each level."""
    return louvain(g, weight, resolution, connected=True)


def reindex_membership(labels: DataFrame) -> DataFrame:
    """(v, label): the labels as 0, 1, .. in the order of each one's least vertex. The table of labels is ordered in one task."""
    from pyspark.sql import Window

    first = labels.groupBy("label").agg(F.min("v").alias("first"))
    return labels.join(first.withColumn("new", F.row_number().over(Window.orderBy("first")) - 1), "label").select("v", F.col("new").cast("long").alias("label"))  # a row for each label


def community_voronoi(g: Graph, generators: DataFrame, weight: str | None = None) -> DataFrame:
    """(v, community): the cell of each vertex around the generators."""
    from lattica.operators.paths import voronoi

    return voronoi(g, generators, weight).select("v", F.col("cell").alias("community"))


# Sequential methods: near[v][u] is the summed weight between v and u.


def _near(vertices: list[int], edges: list[tuple[int, int, int]]) -> dict[int, dict[int, float]]:
    near: dict[int, dict[int, float]] = {v: defaultdict(float) for v in vertices}
    for _, a, b in edges:
        near[a][b] += 1.0
        if a != b:
            near[b][a] += 1.0
    return near


def _quality(near: dict, group: dict[int, int]) -> float:
    total = sum(sum(x.values()) for x in near.values()) or 1.0
    volume: dict[int, float] = defaultdict(float)
    inside = 0.0
    for v, x in near.items():
        volume[group[v]] += sum(x.values())
        inside += sum(w for u, w in x.items() if group[u] == group[v])
    return inside / total - sum(x * x for x in volume.values()) / (total * total)


def _named(group: dict[int, int]):
    least: dict[int, int] = {}
    for v in sorted(group):
        least.setdefault(group[v], v)
    return ((v, least[group[v]]) for v in sorted(group))


def _best_cut(near: dict, merges: list[tuple[int, int]]) -> dict[int, int]:
    """The partition of highest modularity along a sequence of merges of group names."""
    group = {v: v for v in near}
    best, quality = dict(group), _quality(near, group)
    for a, b in merges:
        group = {v: a if c == b else c for v, c in group.items()}
        if (now := _quality(near, group)) > quality + 1e-12:
            best, quality = dict(group), now
    return best


def fast_greedy(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(v, community): groups merged where modularity gains most, ties to the least names, and cut where it was highest."""

    def kernel(vertices, edges):
        near = _near(vertices, edges)
        total = sum(sum(x.values()) for x in near.values()) or 1.0
        links = {v: {u: w for u, w in x.items() if u != v} for v, x in near.items()}
        volume = {v: sum(x.values()) for v, x in near.items()}
        gain = lambda a, b: 2 * (links[a][b] / total - volume[a] * volume[b] / (total * total))
        heap = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b]
        heapq.heapify(heap)
        merges = []
        while heap:
            value, a, b = heapq.heappop(heap)
            if a not in links or b not in links[a] or abs(-value - gain(a, b)) > 1e-15:
                continue
            merges.append((a, b))
            for c, w in links.pop(b).items():
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
                del links[c][b]
            volume[a] += volume.pop(b)
            for c in links[a]:
                heapq.heappush(heap, (-gain(a, c), min(a, c), max(a, c)))
        yield from _named(_best_cut(near, merges))

    return per_component(g, kernel, "v long, community long", most_edges)


def walktrap(g: Graph, steps: int = 4, most_edges: int = 20_000) -> DataFrame:
    """(v, community): neighbouring groups whose short walks end alike are merged, the closest first, and cut where modularity was highest."""

    def kernel(vertices, edges):
        near = _near(vertices, edges)
        at = {v: i for i, v in enumerate(vertices)}
        a = np.eye(len(vertices))  # a loop at each vertex, as the method has it
        for v, x in near.items():
            for u, w in x.items():
                a[at[v], at[u]] += w
        d = a.sum(1)
        walk = np.linalg.matrix_power(a / d[:, None], steps) / np.sqrt(d)
        place, size = {v: walk[at[v]] for v in vertices}, dict.fromkeys(vertices, 1)
        links = {v: set(x) - {v} for v, x in near.items()}
        apart = lambda x, y: size[x] * size[y] / (size[x] + size[y]) * float(((place[x] - place[y]) ** 2).sum())
        heap = [(apart(x, y), x, y) for x in links for y in links[x] if x < y]
        heapq.heapify(heap)
        merges = []
        while heap:
            value, x, y = heapq.heappop(heap)
            if x not in links or y not in links[x] or abs(value - apart(x, y)) > 1e-15:
                continue
            merges.append((x, y))
            place[x] = (size[x] * place[x] + size[y] * place[y]) / (size[x] + size[y])
            size[x] += size[y]
            for z in links.pop(y):
                links[z].discard(y)
                if z != x:
                    links[z].add(x)
                    links[x].add(z)
            for z in links[x]:
                heapq.heappush(heap, (apart(x, z), min(x, z), max(x, z)))
        yield from _named(_best_cut(near, merges))

    return per_component(g, kernel, "v long, community long", most_edges)


def leading_eigenvector(g: Graph, most_edges: int = 20_000) -> DataFrame:
    """(v, community): groups split by the sign of the modularity matrix's leading eigenvector as long as that raises modularity."""

    def kernel(vertices, edges):
        near = _near(vertices, edges)
        at = {v: i for i, v in enumerate(vertices)}
        a = np.zeros((len(vertices), len(vertices)))
        for v, x in near.items():
            for u, w in x.items():
                a[at[v], at[u]] = w
        d, total = a.sum(1), a.sum() or 1.0
        b = a - np.outer(d, d) / total
        group, todo, names = np.zeros(len(vertices), int), deque([0]), 1
        while todo:
            c = todo.popleft()
            inside = np.flatnonzero(group == c)
            m = b[np.ix_(inside, inside)]
            m = m - np.diag(m.sum(1))
            values, vectors = np.linalg.eigh(m)
            side = vectors[:, -1] > 0
            s = np.where(side, 1.0, -1.0)
            if values[-1] > 1e-9 and side.any() and not side.all() and s @ m @ s > 1e-9:
                group[inside[side]] = names
                todo += [c, names]
                names += 1
        yield from _named({v: int(group[at[v]]) for v in vertices})

    return per_component(g, kernel, "v long, community long", most_edges)


def edge_betweenness_communities(g: Graph, most_edges: int = 2_000) -> DataFrame:
    """(v, community): the edge that most shortest paths take goes, again and again; the components of highest modularity on the way."""

    def kernel(vertices, edges):
        near = _near(vertices, edges)
        left = {v: set(x) - {v} for v, x in near.items()}
        best, quality = dict.fromkeys(vertices, vertices[0]), None
        while True:
            group: dict[int, int] = {}
            for v in vertices:
                todo = [v] if v not in group else []
                while todo:
                    x = todo.pop()
                    if x not in group:
                        group[x] = v
                        todo += left[x]
            now = _quality(near, group)
            if quality is None or now > quality + 1e-12:
                best, quality = group, now
            if not any(left.values()):
                break
            load: dict[tuple[int, int], float] = defaultdict(float)
            for s in vertices:  # Brandes' accumulation
                order, paths, dist, before = [], defaultdict(float, {s: 1.0}), {s: 0}, defaultdict(list)
                queue = deque([s])
                while queue:
                    x = queue.popleft()
                    order.append(x)
                    for y in left[x]:
                        if y not in dist:
                            dist[y] = dist[x] + 1
                            queue.append(y)
                        if dist[y] == dist[x] + 1:
                            paths[y] += paths[x]
                            before[y].append(x)
                part: dict[int, float] = defaultdict(float)
                for y in reversed(order):
                    for x in before[y]:
                        share = paths[x] / paths[y] * (1 + part[y])
                        part[x] += share
                        load[min(x, y), max(x, y)] += share
            a, b = max(load, key=lambda e: (round(load[e], 9), -e[0], -e[1]))
            left[a].discard(b)
            left[b].discard(a)
        yield from _named(best)

    return per_component(g, kernel, "v long, community long", most_edges)


def fluid_communities(g: Graph, k: int, seed: int = 0, rounds: int = 100, most_edges: int = 200_000) -> DataFrame:
    """(v, community): k fluids, of density one over their vertices, push each other round in each component until nothing moves; ties as drawn."""

    def kernel(vertices, edges):
        near, rng = _near(vertices, edges), np.random.Generator(np.random.PCG64([seed, vertices[0] & 0xFFFFFFFF]))
        group = {int(v): i for i, v in enumerate(rng.permutation(vertices)[: min(k, len(vertices))])}
        count = defaultdict(int, {i: 1 for i in group.values()})
        for _ in range(rounds):
            changed = False
            for v in rng.permutation(vertices).tolist():
                push: dict[int, float] = defaultdict(float)
                for u in {v, *near[v]}:
                    if u in group:
                        push[group[u]] += 1.0 / count[group[u]]
                if not push:
                    continue
                top = max(push.values())
                ties = sorted(c for c, x in push.items() if x > top - 1e-9)
                if group.get(v) not in ties:
                    if v in group:
                        count[group[v]] -= 1
                    group[v] = ties[int(rng.integers(len(ties)))]
                    count[group[v]] += 1
                    changed = True
            if not changed:
                break
        yield from _named({v: group.get(v, -1) for v in vertices})

    return per_component(g, kernel, "v long, community long", most_edges)
