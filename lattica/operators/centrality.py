"""Centralities by shortest paths, weights and walks, with modes, cutoffs and subsets; diffusion of signals.

Directions are a matter of the graph: ``Graph.as_mode`` turns it round or makes it undirected first.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.distances import distances, weighted_distances

#: Relative difference up to which two path lengths by weight count as equal.
CLOSE = 1e-12


def path_table(g: Graph, sources: DataFrame | None = None, weight: str | None = None, cutoff: float | None = None) -> DataFrame:
    """(s, t, dist) by steps or by weight, up to ``cutoff``."""
    if weight is None:
        return distances(g, sources, None if cutoff is None else int(cutoff)).select("s", "t", F.col("dist").cast("double").alias("dist"))
    table = weighted_distances(g, g.vertices.select("v") if sources is None else sources, weight)
    return table if cutoff is None else table.where(F.col("dist") <= cutoff)


def path_dag(g: Graph, table: DataFrame, weight: str | None = None) -> DataFrame:
    """(s, v, u, eid): the slots that shortest paths from s take; parallel edges each."""
    length = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    slots = g.slots.where("v != u").select("v", "u", "eid", length.alias("w"))
    near = table.select("s", F.col("t").alias("v"), F.col("dist").alias("a"))
    far = table.select("s", F.col("t").alias("u"), F.col("dist").alias("b"))
    return near.join(slots, "v").join(far, ["s", "u"]).where(F.abs(F.expr("a + w - b")) <= CLOSE * F.greatest(F.lit(1.0), F.abs("b"))).select("s", "v", "u", "eid")


def _walked(start: DataFrame, steps: DataFrame) -> DataFrame:
    """(s, t, x): ``start`` (s, t, x) and all that it gives when passed on along ``steps`` (s, from, to) again and again; for steps without cycles."""
    parts, front = [start], start
    while True:
        front = store(front.withColumnRenamed("t", "from").join(steps, ["s", "from"]).groupBy("s", F.col("to").alias("t")).agg(F.sum("x").alias("x")))
        if front.isEmpty():
            break
        parts.append(front)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return store(whole.groupBy("s", "t").agg(F.sum("x").alias("x")))


def shortest_path_flows(g: Graph, sources: DataFrame | None = None, targets: DataFrame | None = None, weight: str | None = None, cutoff: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(v, betweenness) and (eid, betweenness): how many shortest paths pass, each pair of ends sharing one among its paths; halved if undirected.

    Paths go from ``sources`` to ``targets`` (all, if None) and are no longer than ``cutoff``. With sigma paths from s to each
    vertex, x = [target] / sigma, passed on backwards along the slots of shortest paths, sums to what a vertex
    hands on; so both directions are rounds of one join, as many as a shortest path has edges.
    """
    table = store(path_table(g, sources, weight, cutoff))
    dag = store(path_dag(g, table, weight))
    roots = table.where("s = t").select("s", "t", F.lit(1.0).alias("x"))
    paths = _walked(roots, dag.select("s", F.col("v").alias("from"), F.col("u").alias("to"))).withColumnRenamed("x", "sigma")
    wanted = paths if targets is None else paths.join(targets.select(F.col("v").alias("t")).distinct(), "t", "left_semi")
    ends = wanted.where("s != t").select("s", "t", (1 / F.col("sigma")).alias("x"))
    back = _walked(store(ends), dag.select("s", F.col("u").alias("from"), F.col("v").alias("to")))
    half = 1.0 if g.directed else 0.5
    through = back.join(paths, ["s", "t"]).join(ends.select("s", "t", F.lit(1.0).alias("own")), ["s", "t"], "left").where("s != t")
    at = through.groupBy(F.col("t").alias("v")).agg((half * F.sum(F.expr("sigma * x - coalesce(own, 0.0D)"))).alias("b"))
    vertices = g.vertices.select("v").join(at, "v", "left").select("v", F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(0.0)).alias("betweenness"))
    over = dag.join(paths.select("s", F.col("t").alias("v"), "sigma"), ["s", "v"]).join(back.select("s", F.col("t").alias("u"), "x"), ["s", "u"])
    over = over.groupBy("eid").agg((half * F.sum(F.expr("sigma * x"))).alias("b"))
    edges = g.edges.select("eid").join(over, "eid", "left").select("eid", F.coalesce("b", F.lit(0.0)).alias("betweenness"))
    return vertices, edges


def distance_centralities(table: DataFrame, n: int) -> DataFrame:
    """(v, reach, farness, closeness, harmonic, eccentricity) from a distance table: closeness is reach / farness, null if nothing is reached; harmonic is divided by n - 1."""
    t = table.where("s != t").groupBy(F.col("s").alias("v")).agg(F.count("*").alias("reach"), F.sum(real("dist")).alias("farness"), F.sum(1 / real("dist")).alias("h"), F.max(real("dist")).alias("eccentricity"))
    every = table.where("s = t").select(F.col("s").alias("v")).join(t, "v", "left")
    return every.select(
        "v", F.coalesce("reach", F.lit(0)).cast("long").alias("reach"), F.coalesce("farness", F.lit(0.0)).alias("farness"), (F.col("reach") / F.col("farness")).alias("closeness"),
        (F.coalesce("h", F.lit(0.0)) / max(n - 1, 1)).alias("harmonic"), F.coalesce("eccentricity", F.lit(0.0)).alias("eccentricity"),
    )


def centralization(scores: DataFrame, score: str, most: float | None = None) -> DataFrame:
    """(centralization): n max - sum of a column, divided by ``most`` if given."""
    value = F.count("*") * F.max(score) - F.sum(score)
    return scores.agg(real(value / most if most is not None else value).alias("centralization"))


def degree_tmax(n: int, directed: bool = False, mode: str = "all", loops: str = "none") -> float:
    """The largest degree centralization that n vertices allow; loops: none, once or twice (each counted so often)."""
    if n == 0:
        return math.nan
    if not directed:
        return float((n - 1) * (n - 2) if loops == "none" else n * (n - 1)) if loops != "once" else float((n - 1) * (n - 1))
    if mode in ("in", "out"):
        return float((n - 1) * (n - 1) if loops == "none" else n * (n - 1))
    return float(2 * (n - 1) * (n - 2) if loops == "none" else 2 * (n - 1) * (n - 1))


def betweenness_tmax(n: int, directed: bool = False) -> float:
    return math.nan if n == 0 else (n - 1) * (n - 1) * (n - 2) / (1.0 if directed else 2.0)


def closeness_tmax(n: int, mode: str = "all") -> float:
    if n == 0:
        return math.nan
    return (n - 1) * (1.0 - 1.0 / n) if mode != "all" else (n - 1) * (n - 2) / (2.0 * n - 3)


def eigenvector_tmax(n: int, mode: str = "all") -> float:
    return math.nan if n == 0 else 0.0 if n == 1 else float(n - 1) if mode != "all" else float(n - 2)


def convergence_degree(g: Graph) -> DataFrame:
    """(eid, in_size, out_size, convergence): sources and sinks whose shortest paths take the edge, and their difference over their sum (null if none).

    Undirected edges are taken from the lower end to the higher and back, and the larger set is the in-set.
    """
    table = store(path_table(g))
    dag = path_dag(g, table)
    # sinks: every vertex that a shortest path from s reaches through the slot
    reach = table.select("s", "t", "dist")
    ends = store(dag.alias("e").join(reach.alias("a"), F.expr("a.s = e.s")).join(reach.alias("b"), F.expr("b.s = e.u and b.t = a.t")).join(reach.alias("c"), F.expr("c.s = e.s and c.t = e.u")).where("abs(c.dist + b.dist - a.dist) < 1e-9").select("e.s", "a.t", "e.eid", "e.v", "e.u"))
    sides = ends.groupBy("eid", "v", "u").agg(F.count_distinct("s").alias("i"), F.count_distinct("t").alias("o"))
    one = sides.groupBy("eid").agg(F.max("i").alias("i"), F.min("o").alias("o")) if g.directed else sides.groupBy("eid").agg(F.max("i").alias("i"), F.min("i").alias("o"))
    return g.edges.select("eid").join(one, "eid", "left").select("eid", real("i").alias("in_size"), real("o").alias("out_size"), real(F.expr("(i - o) / (i + o)")).alias("convergence"))


def degree_assortativity(g: Graph, weight: str | None = None) -> DataFrame:
    """(assortativity): correlation of strengths at the ends of edges, weighted; undirected edges count both ways. Null where undefined."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    slots = g.slots.select("v", "u", "eid", w.alias("w"))
    out = slots.groupBy("v").agg(F.sum("w").alias("x"))
    into = slots.groupBy("u").agg(F.sum("w").alias("y"))
    e = slots.join(out, "v").join(into, "u")
    t = e.agg(*[F.sum(F.expr(x)).alias(n) for n, x in {"total": "w", "xy": "w * x * y", "x1": "w * x", "y1": "w * y", "x2": "w * x * x", "y2": "w * y * y"}.items()])
    down = "sqrt(x2 - x1 * x1 / total) * sqrt(y2 - y1 * y1 / total)"
    return t.select(real(F.expr(f"case when {down} > 1e-12 then (xy - x1 * y1 / total) / ({down}) end")).alias("assortativity"))


def weighted_neighbor_degrees(g: Graph, weight: str = "weight") -> DataFrame:
    """(v, degree, strength, knn): the mean degree of the neighbours, by weight; null without weight. Simple undirected graphs."""
    d = g.degrees()
    e = g.slots.select("v", "u", F.col(weight).cast("double").alias("w")).join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u")
    at = e.groupBy("v").agg(F.sum("w").alias("strength"), F.sum(F.expr("w * du")).alias("wd"))
    return d.join(at, "v", "left").select("v", F.col("d").alias("degree"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.expr("wd / nullif(strength, 0)").alias("knn"), F.coalesce("wd", F.lit(0.0)).alias("weighted_degrees"))


def weighted_knnk(g: Graph, weight: str = "weight") -> DataFrame:
    """(degree, knnk): over the vertices of a degree, their weighted neighbour degrees over their strengths."""
    return weighted_neighbor_degrees(g, weight).where("degree > 0").groupBy("degree").agg(F.expr("sum(weighted_degrees) / nullif(sum(strength), 0)").alias("knnk"))


def diversity(g: Graph, weight: str = "weight") -> DataFrame:
    """(v, diversity): the entropy of a vertex's weights over the log of its degree; 0 for degree 1, null without edges or weight."""
    at = g.slots.select("v", F.col(weight).cast("double").alias("w")).groupBy("v").agg(F.count("*").alias("k"), F.sum("w").alias("s"), F.sum(F.expr("case when w > 0 then w * ln(w) else 0 end")).alias("wl"))
    value = F.expr("case when s > 0 then case when k = 1 then 0.0D else (ln(s) - wl / s) / ln(k) end end")
    return g.vertices.select("v").join(at, "v", "left").select("v", value.cast("double").alias("diversity"))


def barrat_transitivity(g: Graph, weight: str = "weight") -> DataFrame:
    """(v, transitivity): Barrat's weighted local transitivity; null below degree 2 or without weight. Simple undirected graphs."""
    from lattica.operators.triangles import list_triangles

    w = g.slots.select("v", "u", F.col(weight).cast("double").alias("w"))
    at = w.groupBy("v").agg(F.count("*").alias("d"), F.sum("w").alias("s"))
    corners = list_triangles(g).select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x, y in (("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"))])).alias("p")).select("p.*")
    closed = corners.join(w, ["v", "u"]).groupBy("v").agg(F.sum("w").alias("t"))
    both = at.join(closed, "v", "left").select("v", F.expr("case when d >= 2 and s > 0 then coalesce(t, 0) / (s * (d - 1)) end").alias("transitivity"))
    return g.vertices.select("v").join(both, "v", "left")


def degree_profile(g: Graph) -> DataFrame:
    """(v, degree, degree_squared, log_degree)."""
    return g.degrees().select("v", real("d").alias("degree"), real(F.col("d") * F.col("d")).alias("degree_squared"), F.log2(F.col("d") + 1).alias("log_degree"))


def degree_correlation_vector(g: Graph) -> DataFrame:
    """(degree, knn): the mean degree at the other end of the slots of vertices of a degree; degrees that nobody has, or without slots, have no row."""
    d = g.degrees()
    e = g.slots.select("v", "u").join(d, "v").join(d.select(F.col("v").alias("u"), F.col("d").alias("x")), "u")
    return e.groupBy(F.col("d").alias("degree")).agg(F.avg("x").alias("knn"))


def rich_club_sequence(g: Graph, order: DataFrame, normalized: bool = True) -> DataFrame:
    """(i, edges): edges left before vertex i of ``order`` (v, i from 0) goes, all earlier gone; over the pairs left if normalized. Simple graphs."""
    n = order.count()
    e = g.edges.select("src", "dst").join(order.select(F.col("v").alias("src"), F.col("i").alias("x")), "src").join(order.select(F.col("v").alias("dst"), F.col("i").alias("y")), "dst")
    gone = e.groupBy(F.least("x", "y").alias("i")).agg(F.count("*").alias("k"))
    # an edge is there until the first of its ends goes; cumulative by a join with bounds over the counts
    left = order.select("i").join(gone.select(F.col("i").alias("j"), "k"), F.expr("j >= i"), "left").groupBy("i").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("m"))
    pairs = F.expr(f"({n} - i) * ({n} - i - 1) / {1.0 if g.directed else 2.0}D")
    return left.select("i", real(F.expr("m") / F.when(pairs > 0, pairs)).alias("edges")) if normalized else left.select("i", real("m").alias("edges"))


def _transition(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(v, u, p), the share of a vertex's mass that each neighbour gets, and (v) without neighbours."""
    slots = g.slots.groupBy("v", "u").agg(F.count("*").alias("k"))
    d = slots.groupBy("v").agg(F.sum("k").alias("d"))
    return store(slots.join(d, "v").select("v", "u", (F.col("k") / F.col("d")).alias("p"))), store(g.vertices.select("v").join(d, "v", "left_anti"))


def _pushed(state: DataFrame, steps: DataFrame, lone: DataFrame) -> DataFrame:
    """(v, x) after one step; lone vertices keep what they have."""
    moved = state.join(steps, "v").select(F.col("u").alias("v"), (F.col("x") * F.col("p")).alias("x"))
    return moved.unionByName(state.join(lone, "v", "left_semi").select("v", "x")).groupBy("v").agg(F.sum("x").alias("x"))


def heat_kernel_diffuse(g: Graph, signal: DataFrame, t: float, terms: int = 30) -> DataFrame:
    """(v, x): the signal (v, x) after k steps, weighted by the Poisson chance of k at mean t, for k up to ``terms`` or until the chance is under 1e-15."""
    steps, lone = _transition(g)
    state, chance = store(signal.select("v", real("x").alias("x"))), math.exp(-t)
    parts = [state.select("v", (F.col("x") * chance).alias("x"))]
    for k in range(1, terms + 1):
        chance *= t / k
        if chance < 1e-15:
            break
        state = store(_pushed(state, steps, lone))
        parts.append(state.select("v", (F.col("x") * chance).alias("x")))
    return _summed(g, parts)


def ppr_diffuse(g: Graph, signal: DataFrame, alpha: float, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(v, x): x = alpha signal + (1 - alpha) pushed(x), from the signal, until the L1 change is under ``tolerance`` or after ``rounds``."""
    steps, lone = _transition(g)
    first = store(signal.select("v", real("x").alias("x")))
    state = first
    for _ in range(rounds):
        new = store(_summed(g, [first.select("v", (alpha * F.col("x")).alias("x")), _pushed(state, steps, lone).select("v", ((1 - alpha) * F.col("x")).alias("x"))]))
        change = new.join(state.withColumnRenamed("x", "old"), "v").agg(F.sum(F.abs(F.expr("x - coalesce(old, 0)")))).first()[0] or 0.0
        state = new
        if change < tolerance:
            break
    return state


def _summed(g: Graph, parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    total = whole.groupBy("v").agg(F.sum("x").alias("x"))
    return g.vertices.select("v").join(total, "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("x"))


def rwpe(g: Graph, steps: int, vertices: DataFrame | None = None) -> DataFrame:
    """(v, step, p): the chance that a walk from v is back after 1 .. ``steps`` steps. The walks' table has a row for each pair in reach."""
    moves, lone = _transition(g)
    state = store((g.vertices if vertices is None else vertices).select(F.col("v").alias("s"), "v", F.lit(1.0).alias("x")))
    starts, out = state.select("s"), None
    for k in range(1, steps + 1):
        moved = state.join(moves, "v").select("s", F.col("u").alias("v"), (F.col("x") * F.col("p")).alias("x"))
        state = store(moved.unionByName(state.join(lone, "v", "left_semi").select("s", "v", "x")).groupBy("s", "v").agg(F.sum("x").alias("x")))
        here = starts.join(state.where("s = v").select("s", "x"), "s", "left").select(F.col("s").alias("v"), F.lit(k).cast("long").alias("step"), F.coalesce("x", F.lit(0.0)).alias("p"))
        out = here if out is None else out.unionByName(here)
    return out


def attention_aggregate(g: Graph, signal: DataFrame, attention: DataFrame) -> DataFrame:
    """(v, x): the neighbours' signal (v, x), weighted by the softmax of the attention (eid, a) of the edges to them; 0 without neighbours."""
    e = g.slots.select("v", "u", "eid").join(attention, "eid").join(signal.select(F.col("v").alias("u"), real("x").alias("x")), "u")
    top = e.groupBy("v").agg(F.max("a").alias("top"))
    at = e.join(top, "v").groupBy("v").agg(F.expr("sum(exp(a - top) * x) / sum(exp(a - top))").alias("x"))
    return g.vertices.select("v").join(at, "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("x"))


def majority_labels(g: Graph, labels: DataFrame) -> DataFrame:
    """(v, label): its own if it has one, else the most common among its labelled neighbours; ties, and no labelled neighbour, give the highest label."""
    highest = labels.agg(F.max("label").alias("highest"))
    votes = g.slots.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v", "label").agg(F.count("*").alias("k"))
    best = votes.groupBy("v").agg(F.max(F.struct("k", "label")).alias("b")).select("v", F.col("b.label").alias("voted"))
    every = g.vertices.select("v").join(labels, "v", "left").join(best, "v", "left").crossJoin(F.broadcast(highest))  # one row
    return every.select("v", F.coalesce("label", "voted", "highest").alias("label"))


def partition_cuts(g: Graph, labels: DataFrame, weight: str | None = None) -> DataFrame:
    """(conductance, expansion): with two groups, what is cut over the smaller volume or size; with more, the worst group's."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = g.edges.select("src", "dst", w.alias("w")).join(labels.select(F.col("v").alias("src"), F.col("label").alias("x")), "src").join(labels.select(F.col("v").alias("dst"), F.col("label").alias("y")), "dst")
    ends = e.select(F.explode(F.array("x", "y")).alias("label"), "w", (F.col("x") != F.col("y")).alias("out"))
    groups = labels.groupBy("label").agg(F.count("*").alias("size")).join(ends.groupBy("label").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("out"), F.col("w")).otherwise(0.0)).alias("cut")), "label", "left").na.fill(0.0, ["vol", "cut"])
    # with two groups both cuts are equal, so the worst is the one over the smaller volume
    return groups.agg(real(F.coalesce(F.max(F.expr("cut / nullif(vol, 0)")), F.lit(0.0))).alias("conductance"), real(F.max(F.expr("cut / size"))).alias("expansion"))


def class_homophily(g: Graph, labels: DataFrame) -> DataFrame:
    """(class_homophily, edge_heterophily): the mean over classes of (share of slots that stay, less the class's share of vertices) over the rest; and the share of edges that leave."""
    n = labels.count()
    e = g.slots.join(labels.select("v", F.col("label").alias("x")), "v").join(labels.select(F.col("v").alias("u"), F.col("label").alias("y")), "u")
    stays = e.groupBy(F.col("x").alias("label")).agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("h"))
    c = labels.groupBy("label").agg((F.count("*") / n).alias("share")).join(stays, "label", "left")
    one = c.agg(F.avg(F.expr("(coalesce(h, 0) - share) / (1 - share)")).alias("class_homophily"))
    two = e.agg(F.avg((F.col("x") != F.col("y")).cast("double")).alias("edge_heterophily"))
    return one.crossJoin(two)  # one row each
