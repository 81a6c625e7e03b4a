"""Fixed points: rounds of joins and aggregations, each a written table, until nothing changes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.twins import merged
from lattica.shipping import ship


def connected_components(g: Graph) -> DataFrame:
    """(v, component): the least vertex of each weak component, by large-star and small-star rounds, which grow with the logarithm of the diameter."""
    e = store(g.edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("w")).distinct())
    before = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()) != before and now[0]:
        before = now
        both = e.unionByName(e.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).distinct()
        least = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(least, "u").where("w != m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        e = store(small.unionByName(least.select("u", F.col("m").alias("w"))).distinct())
    return g.vertices.select("v").join(e.select(F.col("u").alias("v"), F.col("w").alias("c")), "v", "left").select("v", F.coalesce("c", "v").alias("component"))


def reachability(g: Graph) -> DataFrame:
    """(s, t): every pair with a path, a vertex with itself; doubling, so rounds grow with the logarithm of the longest path."""
    known = store(g.slots.select(F.col("v").alias("s"), F.col("u").alias("t")).unionByName(g.vertices.select(F.col("v").alias("s"), F.col("v").alias("t"))).distinct())
    n = known.count()
    while True:
        known = store(known.join(known.select(F.col("s").alias("t"), F.col("t").alias("w")), "t").select("s", F.col("w").alias("t")).distinct())
        if (more := known.count()) == n:
            return known
        n = more


def strongly_connected_components(g: Graph) -> DataFrame:
    """(v, component): the least vertex that reaches and is reached. Forward-backward colouring: every round settles all colours' roots.

    Labels flow forward to the least colour; of each colour, what reaches its root backward is a component and leaves.
    """
    left, edges, done = g.vertices.select("v"), g.edges.where("src != dst").select("src", "dst").distinct(), None
    while True:
        left, edges = store(left), store(edges)
        if left.isEmpty():
            return done
        colour = store(left.withColumn("c", F.col("v")))
        while True:
            offers = edges.join(colour.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("o"))
            new = store(colour.join(offers, "v", "left").select("v", F.least("c", "o").alias("c"), (F.col("o") < F.col("c")).alias("x")))
            changed = not new.where("x").isEmpty()
            colour = new.select("v", "c")
            if not changed:
                break
        inside = store(edges.join(colour.select(F.col("v").alias("src"), "c"), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("c2")), "dst").where("c = c2").select("src", "dst"))
        found = front = store(colour.where("v = c"))
        while not front.isEmpty():
            back = inside.join(front.select(F.col("v").alias("dst"), "c"), "dst").select(F.col("src").alias("v"), "c").distinct()
            front = store(back.join(found, "v", "left_anti"))
            found = store(found.unionByName(front))
        done = found.withColumnRenamed("c", "component") if done is None else done.unionByName(found.withColumnRenamed("c", "component"))
        left = left.join(found, "v", "left_anti")
        edges = edges.join(found.select(F.col("v").alias("src")), "src", "left_anti").join(found.select(F.col("v").alias("dst")), "dst", "left_anti")


def pagerank(g: Graph, damping: float = 0.85, tolerance: float = 1e-10, rounds: int = 1000, reset: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """(v, rank): the power method from 1/n; a vertex without out-slots spreads evenly; ``reset`` (v, p) personalizes, ``weight`` divides a vertex's rank among its slots. Stops at an L1 change under ``tolerance`` or after ``rounds``."""
    n = g.vertices.count()
    slots = g.slots.groupBy("v", "u").agg((F.count("*") if weight is None else F.sum(real(weight))).alias("k"))
    out = slots.groupBy("v").agg(F.sum("k").alias("d")).where("d > 0")
    steps = store(slots.join(out, "v").select("v", "u", (F.col("k") / F.col("d")).alias("share")))
    base = store(g.vertices.select("v").join(out, "v", "left").select("v", F.col("d").isNull().alias("dangling")))
    if reset is not None:
        base = store(base.join(reset.select("v", "p"), "v", "left").select("v", "dangling", F.coalesce("p", F.lit(0.0)).alias("p")))
    else:
        base = base.withColumn("p", F.lit(1.0 / max(n, 1)))
    rank = base.select("v", F.lit(1.0 / max(n, 1)).alias("rank"))
    for turn in range(rounds):
        lost = base.where("dangling").join(rank, "v").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"), F.lit(1).alias("one"))
        got = steps.join(rank, "v").groupBy(F.col("u").alias("v")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = base.join(got, "v", "left").join(rank.withColumnRenamed("rank", "old"), "v").withColumn("one", F.lit(1)).join(F.broadcast(lost), "one")  # one row
        value = (1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))
        new = new.select("v", value.alias("rank"), F.abs(value - F.col("old")).alias("change"))
        if turn % 3 == 2 or turn + 1 == rounds:
            new = store(new)
            if new.agg(F.sum("change")).first()[0] < tolerance:
                return new.select("v", "rank")
        rank = new.select("v", "rank")
    return rank


def power_step(g: Graph, state: DataFrame, transpose: bool = False, weight: str | None = None) -> DataFrame:
    """(v, x): sums of a state (v, x) over neighbour slots, times their weight; over in-slots if ``transpose``."""
    w = F.lit(1.0) if weight is None else real(weight)
    slots = g.slots.select(F.col("u").alias("v"), F.col("v").alias("u"), w.alias("w")) if transpose else g.slots.select("v", "u", w.alias("w"))
    return slots.join(state.select(F.col("v").alias("u"), "x"), "u").groupBy("v").agg(F.sum(F.col("x") * F.col("w")).alias("x"))


def _filled(g: Graph, state: DataFrame) -> DataFrame:
    return g.vertices.select("v").join(state, "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("x"))


#: Steps between vertices, twins merged, up to which Katz rounds run in one task; more run as tables.
STEPS = 1_000_000


def katz_centrality(g: Graph, alpha: float, beta: float = 1.0, tolerance: float = 1e-6, rounds: int = 1000) -> DataFrame:
    """(v, x): c = alpha A' c + beta from 0, until the L2 change is under ``tolerance``. Twins of an undirected graph without loops share a row."""
    if not g.directed and g.edges.where("src = dst").isEmpty():
        q, classes = merged(g)
        steps = q.slots.join(q.vertices.select(F.col("v").alias("u"), F.col("size").alias("many")), "u").select("v", "u", (F.col("k") * F.col("many")).cast("double").alias("w"))
        vertices = q.vertices
    else:
        classes, vertices = None, g.vertices.select("v", F.lit(1).cast("long").alias("size"))
        steps = g.slots.groupBy(F.col("u").alias("v"), F.col("v").alias("u")).agg(F.count("*").cast("double").alias("w"))
    steps = store(steps)
    found = _katz_here(vertices, steps, alpha, beta, tolerance, rounds) if steps.count() <= STEPS and vertices.count() <= STEPS else _katz_tables(store(vertices), steps, alpha, beta, tolerance, rounds)
    if found is None:
        raise ArithmeticError("Katz centrality did not converge: alpha must be under the reciprocal of the largest eigenvalue")
    return found if classes is None else found.withColumnRenamed("v", "c").join(classes, "c").select("v", "x")


def _katz_here(vertices: DataFrame, steps: DataFrame, alpha: float, beta: float, tolerance: float, rounds: int) -> DataFrame | None:
    """The rounds in one task; None if they don't settle."""
    ship(steps.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, e = part[part.u.isna()].sort_values("v"), part[part.u.notna()]
        names, size = own.v.to_numpy(), own.w.to_numpy()
        into, out = np.searchsorted(names, e.v.to_numpy()), np.searchsorted(names, e.u.to_numpy().astype(np.int64))
        x = np.zeros(len(names))
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(rounds):
                new = alpha * np.bincount(into, e.w.to_numpy() * x[out], len(names)) + beta
                change, x = np.sqrt((size * (new - x) ** 2).sum()), new
                if change < tolerance or not np.isfinite(change):
                    break
        return pd.DataFrame({"v": names, "x": x, "settled": change < tolerance})

    rows = vertices.select("v", F.lit(None).cast("long").alias("u"), F.col("size").cast("double").alias("w")).unionByName(steps)
    found = store(rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "v long, x double, settled boolean"))
    return found.select("v", "x") if found.where("not settled").isEmpty() else None


def _katz_tables(vertices: DataFrame, steps: DataFrame, alpha: float, beta: float, tolerance: float, rounds: int) -> DataFrame | None:
    """A round a table; None if they don't settle."""
    state = vertices.select("v", F.lit(0.0).alias("x"))
    for _ in range(rounds):
        got = steps.join(state.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.sum(F.col("w") * F.col("x")).alias("got"))
        new = store(vertices.join(got, "v", "left").select("v", "size", (alpha * F.coalesce("got", F.lit(0.0)) + beta).alias("x")))
        change = new.join(state.withColumnRenamed("x", "old"), "v").agg(F.sqrt(F.sum(F.col("size") * F.pow(F.col("x") - F.col("old"), 2)))).first()[0] or 0.0
        state = new.select("v", "x")
        if change < tolerance:
            return state
        if not math.isfinite(change):
            return None
    return None


def hub_and_authority_scores(g: Graph, rounds: int = 1000, weight: str | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(v, hub, authority), each with the largest value 1, until no hub changes by ``tolerance`` or after ``rounds`` rounds."""
    hub = g.vertices.select("v", F.lit(1.0).alias("x"))
    for _ in range(rounds):
        authority = _filled(g, power_step(g, hub, True, weight))
        new = _filled(g, power_step(g, authority, False, weight))
        top = new.agg(F.max("x").alias("top"), F.lit(1).alias("one"))
        new = new.withColumn("one", F.lit(1)).join(F.broadcast(top), "one").select("v", (F.col("x") / F.col("top")).alias("x"))  # one row
        new = store(new.join(hub.withColumnRenamed("x", "old"), "v"))
        hub = new.select("v", "x")
        if (new.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    authority = store(_filled(g, power_step(g, hub, True, weight)))
    top = authority.agg(F.max("x")).first()[0]
    return hub.withColumnRenamed("x", "hub").join(authority.select("v", (F.col("x") / top).alias("authority")), "v")


def eigenvector_centrality(g: Graph, tolerance: float = 1e-9, rounds: int = 5000, weight: str | None = None) -> DataFrame:
    """(v, x), the largest 1: the power method on A' + I, which also settles on bipartite graphs."""
    state = g.vertices.select("v", F.lit(1.0).alias("x"))
    for _ in range(rounds):
        stepped = _filled(g, power_step(g, state, True, weight)).join(state.withColumnRenamed("x", "old"), "v").select("v", "old", (F.col("x") + F.col("old")).alias("x"))
        stepped = store(stepped)
        top = stepped.agg(F.max("x")).first()[0]
        state = stepped.select("v", "old", (F.col("x") / top).alias("x"))
        if (state.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
        state = store(state.select("v", "x"))
    return state.select("v", "x")


def coreness(g: Graph) -> DataFrame:
    """(v, coreness) of the neighbour slots: vertices under k peel off together until none is left under k."""
    left, k, done = store(g.vertices.select("v")), 0, None
    slots = store(g.slots.where("v != u").select("v", "u"))
    while not left.isEmpty():
        d = left.join(slots.groupBy("v").agg(F.count("*").alias("d")), "v", "left").select("v", F.coalesce("d", F.lit(0)).alias("d"))
        d = store(d)
        least = d.agg(F.min("d")).first()[0]
        k = max(k, least)
        gone = d.where(F.col("d") <= k).select("v", F.lit(k).cast("long").alias("coreness"))
        done = gone if done is None else done.unionByName(gone)
        left = store(left.join(gone, "v", "left_anti"))
        slots = store(slots.join(gone, "v", "left_anti").join(gone.select(F.col("v").alias("u")), "u", "left_anti"))
    return done if done is not None else g.vertices.select("v", F.lit(0).cast("long").alias("coreness"))


def trussness(g: Graph) -> DataFrame:
    """(a, b, truss) of the simple graph's edges: edges in fewer than k - 2 triangles peel off together."""
    from lattica.operators.triangles import edge_support

    left, k, done = Graph.from_edges(store(g.simple_slots.where("v < u").select(F.col("v").alias("src"), F.col("u").alias("dst"))), False, g.vertices), 2, None
    while True:
        support = store(edge_support(left))
        least = support.agg(F.min("support")).first()[0]
        if least is None:
            return done
        k = max(k, least + 2)
        gone = support.where(F.col("support") <= k - 2).select("a", "b", F.lit(k).cast("long").alias("truss"))
        done = gone if done is None else done.unionByName(gone)
        left = Graph.from_edges(store(support.where(F.col("support") > k - 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))), False, g.vertices)


def minimum_spanning_forest(g: Graph, weight: str = "weight") -> DataFrame:
    """(eid): Borůvka rounds, each component taking its lightest edge out, ties by edge id; rounds grow with the logarithm of n."""
    e = store(g.edges.where("src != dst").select("eid", "src", "dst", F.col(weight).alias("w")))
    label, chosen = g.vertices.select("v", F.col("v").alias("c")), None
    while True:
        across = store(e.join(label.select(F.col("v").alias("src"), F.col("c").alias("x")), "src").join(label.select(F.col("v").alias("dst"), F.col("c").alias("y")), "dst").where("x != y"))
        if across.isEmpty():
            return chosen if chosen is not None else e.select("eid").limit(0)
        ends = across.select(F.explode(F.array("x", "y")).alias("c"), "eid", "w")
        best = ends.groupBy("c").agg(F.min_by("eid", F.struct("w", "eid")).alias("eid")).select("eid").distinct()
        chosen = store(best if chosen is None else chosen.unionByName(best).distinct())
        label = connected_components(Graph(g.vertices, g.edges.join(chosen, "eid", "left_semi"))).withColumnRenamed("component", "c")


def topological_levels(g: Graph) -> DataFrame:
    """(v, level): the longest path to each vertex of an acyclic graph; a cycle is an error. Order by (level, v) to sort."""
    left, e, level, done = store(g.vertices.select("v")), store(g.edges.select("src", "dst")), 0, None
    while not left.isEmpty():
        free = store(left.join(e.select(F.col("dst").alias("v")), "v", "left_anti").withColumn("level", F.lit(level).cast("long")))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        left, e, level = store(left.join(free, "v", "left_anti")), store(e.join(free.select(F.col("v").alias("src")), "src", "left_anti")), level + 1
    return done


def is_dag(g: Graph) -> bool:
    try:
        topological_levels(g)
    except ValueError:
        return False
    return g.directed


def wl_colours(g: Graph, rounds: int = 3) -> DataFrame:
    """(v, colour): Weisfeiler-Lehman refinement, a colour being the hash of the former one and its neighbours' in order."""
    colour = g.degrees().select("v", F.xxhash64("d").alias("colour"))
    for _ in range(rounds):
        around = g.slots.join(colour.select(F.col("v").alias("u"), F.col("colour").alias("c")), "u").groupBy("v").agg(F.sort_array(F.collect_list("c")).alias("cs"))
        colour = store(colour.join(around, "v", "left").select("v", F.xxhash64("colour", "cs").alias("colour")))
    return colour


def label_spread(g: Graph, labels: DataFrame, rounds: int = 30, alpha: float = 0.9) -> DataFrame:
    """(v, label): Y <- alpha S Y + (1 - alpha) Y0 with S the symmetric normalization; ties go to the least label, unreached vertices have none."""
    d = g.degrees()
    s = store(g.slots.join(d, "v").join(d.select(F.col("v").alias("u"), F.col("d").alias("du")), "u").select("v", "u", F.expr("1 / sqrt(d * 1.0D * du)").alias("w")))
    first = labels.where("label is not null").select("v", "label", F.lit(1.0).alias("y"))
    state = first
    for _ in range(rounds):
        spread = s.join(state.withColumnRenamed("v", "u"), "u").groupBy("v", "label").agg((alpha * F.sum(F.col("w") * F.col("y"))).alias("y"))
        state = store(spread.unionByName(first.withColumn("y", F.lit(1 - alpha))).groupBy("v", "label").agg(F.sum("y").alias("y")))
    return state.groupBy("v").agg(F.max_by("label", F.struct("y", -F.col("label"))).alias("label"))


def label_propagation(g: Graph, rounds: int = 20) -> DataFrame:
    """(v, label): each vertex takes the most frequent label around it and its own, ties to the least, all at once, until stable or ``rounds``."""
    state = g.vertices.select("v", F.col("v").alias("label"))
    for _ in range(rounds):
        votes = g.slots.join(state.withColumnRenamed("v", "u"), "u").select("v", "label").unionByName(state).groupBy("v", "label").count()
        new = store(votes.groupBy("v").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("label")))
        if new.join(state.withColumnRenamed("label", "old"), "v").where("label != old").isEmpty():
            return new
        state = new
    return state


def random_walks(g: Graph, starts: DataFrame, steps: int, seed: int) -> DataFrame:
    """(walk, step, v): uniform walks from ``starts`` (walk, v); the draws are hashes, so reruns agree; a walk ends where nothing leaves."""
    ranked = store(g.slots.select("v", "u", "eid").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("u", "eid"))).alias("next")))
    here = starts.select("walk", F.lit(0).cast("long").alias("step"), "v")
    out = here
    for k in range(1, steps + 1):
        moved = here.join(ranked, "v").select("walk", F.lit(k).cast("long").alias("step"), F.element_at("next", (F.pmod(F.xxhash64("walk", F.lit(k), F.lit(seed)), F.size("next").cast("long")) + 1).cast("int")).u.alias("v"))
        here = store(moved)
        out = out.unionByName(here)
    return out
