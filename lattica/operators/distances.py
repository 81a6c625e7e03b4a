"""Shortest-path tables and the measures of them.

Breadth first, all sources at once: the frontier (s, t) is joined with the neighbour slots, and what
the table already has is left out. A round is a written table. All pairs are n squared rows by their nature; ``sources`` bounds
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, real, store
from lattica.operators.twins import merged


def distances(g: Graph, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(s, t, dist, paths): steps and the number of shortest paths (parallel edges multiply); unreachable pairs have no row. Without ``sources`` an undirected graph is searched from one of each class of twins."""
    if not g.directed and sources is None:
        return _expanded(g, *class_distances(g, limit)[:2])
    steps = g.slots.where("v != u").groupBy("v", "u").agg(F.count("*").alias("k"), F.lit(1).cast("long").alias("nt"))
    return _search(steps, (sources if sources is not None else g.vertices).select(F.col("v").alias("s")), limit).drop("nt")


def _search(steps: DataFrame, start: DataFrame, limit: int | None) -> DataFrame:
    """(s, t, dist, paths, nt) from steps (v, u, k, nt), ``nt`` being the vertices that a row's end stands for."""
    frontier = store(start.select("s", F.col("s").alias("t"), F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths"), F.lit(1).cast("long").alias("nt")))
    parts, seen, depth = [frontier], frontier.select("s", "t"), 0
    while limit is None or depth < limit:
        depth += 1
        ways = frontier.select("s", F.col("t").alias("v"), (F.col("paths") * F.col("nt")).alias("ways"))
        reached = ways.join(steps, "v").groupBy("s", F.col("u").alias("t")).agg(F.sum(F.col("ways") * F.col("k")).alias("paths"), F.max("nt").alias("nt"))
        frontier = store(reached.join(seen, ["s", "t"], "left_anti").select("s", "t", F.lit(depth).alias("dist"), "paths", "nt"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier.select("s", "t"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def class_distances(g: Graph, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(s, t, dist, paths, ns, nt) of an undirected graph, the classes of twins (v, c), and the steps between them (v, u, k, nt).

    A row stands for the ns vertices of class s and, for each, the nt at that distance in class t. A class of several has a
    row to itself at 0, for the vertex, and one at 2, for its twins.
    """
    q, classes = merged(g)
    steps = store(_class_steps(q))
    found = _search(steps, q.vertices.select(F.col("v").alias("s")), limit)
    if limit is None or limit >= 2:
        between = steps.groupBy("v").agg(F.sum(F.expr("k * k * nt")).alias("paths"))
        found = found.unionByName(q.vertices.where("size > 1").join(between, "v").select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(2).alias("dist"), "paths", (F.col("size") - 1).alias("nt")))
    return store(found.join(q.vertices.select(F.col("v").alias("s"), F.col("size").alias("ns")), "s")), classes, steps


def _class_steps(q: Graph) -> DataFrame:
    """(v, u, k, nt) both ways between classes: the edges from one of v to each of the nt of u."""
    return q.slots.select("v", "u", "k").join(q.vertices.select(F.col("v").alias("u"), F.col("size").alias("nt")), "u").select("v", "u", "k", "nt")


#: Twins in a list, and rows a task, when rows of classes become rows of pairs.
LIST, TASK = 512, 10_000_000


def _expanded(g: Graph, table: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, t, dist, paths) for every vertex: lists of twins are dealt out by pairs of lists, then multiplied."""
    sizes = classes.groupBy("c").agg(F.count("*").alias("size"))
    lists = store(classes.join(sizes, "c").withColumn("i", F.pmod(F.xxhash64("v"), F.expr(f"size div {LIST} + 1"))).groupBy("c", "i").agg(F.collect_list("v").alias("vs")))
    tasks = 1 + (table.agg(F.sum(F.col("ns") * F.col("nt"))).first()[0] or 0) // TASK
    far = table.where("dist > 0").join(lists.toDF("s", "i", "ss"), "s").join(lists.toDF("t", "j", "tt"), "t").repartition(tasks, "s", "i", "t", "j")
    far = far.select(F.explode("ss").alias("s"), "tt", "dist", "paths").select("s", F.explode("tt").alias("t"), "dist", "paths").where("s != t")
    return g.vertices.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths")).unionByName(far)


def weighted_distances(g: Graph, sources: DataFrame, weight: str = "weight") -> DataFrame:
    """(s, t, dist) by least total weight, Bellman-Ford over tables: rounds until nothing gets shorter; a negative cycle is an error."""
    steps = g.slots.select("v", "u", F.col(weight).cast("double").alias("w")).groupBy("v", "u").agg(F.min("w").alias("w"))
    best = store(sources.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(0.0).alias("dist")))
    changed, rounds, most = best, 0, g.vertices.count()
    while not changed.isEmpty():
        rounds += 1
        if rounds > most:
            raise ValueError("a cycle of negative weight is reachable")
        offers = changed.join(steps.withColumnRenamed("v", "t"), "t").groupBy("s", F.col("u").alias("t")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        merged = store(best.join(offers, ["s", "t"], "full").select("s", "t", F.least("dist", "offer").alias("dist"), (F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).alias("new")))
        best, changed = merged.select("s", "t", "dist"), merged.where("new").select("s", "t", "dist")
    return best


def widest_paths(g: Graph, sources: DataFrame, weight: str = "weight") -> DataFrame:
    """(s, t, width): the largest least weight over paths; a source reaches itself with infinity."""
    steps = g.slots.select("v", "u", F.col(weight).cast("double").alias("w")).groupBy("v", "u").agg(F.max("w").alias("w"))
    best = store(sources.select(F.col("v").alias("s"), F.col("v").alias("t"), F.lit(float("inf")).alias("width")))
    changed = best
    while not changed.isEmpty():
        offers = changed.join(steps.withColumnRenamed("v", "t"), "t").groupBy("s", F.col("u").alias("t")).agg(F.max(F.least("width", "w")).alias("offer"))
        merged = store(best.join(offers, ["s", "t"], "full").select("s", "t", F.greatest("width", "offer").alias("width"), (F.col("width").isNull() | (F.col("offer") > F.col("width"))).alias("new")))
        best, changed = merged.select("s", "t", "width"), merged.where("new").select("s", "t", "width")
    return best


def _ends(table: DataFrame) -> Column:
    """How many vertices the end of a row stands for: one, but in a table of classes."""
    return F.col("nt") if "nt" in table.columns else F.lit(1).cast("long")


def vertex_distances(table: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(v, eccentricity, closeness, harmonic_sum, reachable, farness) from a distance table, or from one of classes (v, c); closeness is reachable / farness, null if nothing is reachable."""
    n = _ends(table)
    t = table.where("dist > 0").groupBy(F.col("s").alias("v")).agg(F.max("dist").alias("eccentricity"), F.sum(n).alias("reachable"), F.sum(F.col("dist") * n).alias("farness"), F.sum(F.expr("1.0D / dist") * n).alias("harmonic_sum"))
    all_ = table.where("dist = 0").select(F.col("s").alias("v")).join(t, "v", "left")
    if classes is not None:
        all_ = all_.withColumnRenamed("v", "c").join(classes, "c")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_.select("v", zero("eccentricity"), real(F.expr("reachable * 1.0D / farness")).alias("closeness"), real(F.coalesce("harmonic_sum", F.lit(0.0))).alias("harmonic_sum"), zero("reachable"), zero("farness"))


def path_length_hist(table: DataFrame, directed: bool) -> DataFrame:
    """(length, pairs): unordered pairs if the graph is undirected, whose table may be of classes."""
    t = table.where("dist > 0")
    if "nt" in table.columns:
        return t.groupBy(F.col("dist").cast("long").alias("length")).agg(F.sum(F.col("ns") * F.col("nt")).alias("pairs")).select("length", F.expr("pairs div 2").alias("pairs"))
    return (t if directed else t.where("s < t")).groupBy(F.col("dist").cast("long").alias("length")).agg(F.count("*").alias("pairs"))


def distance_indices(g: Graph, table: DataFrame | None = None) -> DataFrame:
    """(name, value) for a connected undirected graph: one pass over the pairs, or without a table those of classes, with the degrees of both ends, one over vertices, one over edges."""
    table, classes = class_distances(g)[:2] if table is None else (table, None)
    d = g.degrees()
    once = table.where("s < t").withColumn("w", F.lit(1.0)) if classes is None else table.where("dist > 0").withColumn("w", F.expr("ns * nt / 2.0D"))
    pairs = once.join(d.select(F.col("v").alias("s"), F.col("d").cast("double").alias("x")), "s").join(d.select(F.col("v").alias("t"), F.col("d").cast("double").alias("y")), "t")
    a = pairs.agg(
        F.sum(F.expr("w * (dist * 1.0D)")).alias("wiener_index"), F.sum(F.expr("w * ((dist + dist * dist) / 2.0D)")).alias("hyper_wiener_index"), F.sum(F.expr("w * (1.0D / dist)")).alias("harary_index"), F.sum(F.expr("w * (1.0D / (dist * dist))")).alias("reciprocal_square_harary"),
        F.sum(F.expr("w * ((x + y) * dist)")).alias("schultz_index"), F.sum(F.expr("w * (x * y * dist)")).alias("gutman_index"), F.sum(F.expr("w * ((x + y) / dist)")).alias("additively_weighted_harary"), F.sum(F.expr("w * (x * y / dist)")).alias("multiplicatively_weighted_harary"),
        (F.sum(F.expr("w * dist")) / F.sum("w")).alias("mean_distance"), F.max("dist").cast("double").alias("diameter"), (F.sum(F.expr("w / dist")) / F.sum("w")).alias("global_efficiency"),
    )
    n = _ends(table)
    far = store(table.where("dist > 0").groupBy(F.col("s").alias("v")).agg(F.max("dist").cast("double").alias("ecc"), F.sum(F.col("dist") * n).cast("double").alias("far")))
    v = (far if classes is None else far.withColumnRenamed("v", "c").join(classes, "c").drop("c")).join(d, "v")
    b = v.agg(
        F.min("ecc").alias("radius"), F.sum("ecc").alias("total_eccentricity"), F.avg("ecc").alias("average_eccentricity"), F.sum(F.expr("ecc * ecc")).alias("first_zagreb_eccentricity"), F.sum(F.expr("d / ecc")).alias("connective_eccentricity_index"),
        F.sum(F.expr("d * ecc")).alias("eccentric_connectivity_index"), F.sum(F.expr("ecc * far")).alias("eccentric_distance_sum"), F.sum(F.expr("d * far")).alias("degree_distance"), F.count_if(F.col("ecc") == F.lit(0)).cast("double").alias("isolated"),
    ).drop("isolated")
    e = g.edges.where("src != dst").join(v.select(F.col("v").alias("src"), F.col("ecc").alias("x"), F.col("far").alias("fx")), "src").join(v.select(F.col("v").alias("dst"), F.col("ecc").alias("y"), F.col("far").alias("fy")), "dst")
    n, m = g.vertices.count(), g.edges.count()
    c = e.agg(
        F.sum(F.expr("x * y")).alias("second_zagreb_eccentricity"), F.sum(F.expr("sqrt((x + y - 2) / (x * y))")).alias("fourth_abc_index"), F.sum(F.expr("2 * sqrt(x * y) / (x + y)")).alias("fifth_ga_index"),
        F.sum(F.expr(f"{m} / ({m} - {n} + 2.0D) / sqrt(fx * fy)")).alias("balaban_j_index"), F.sum(F.expr(f"{m} / ({m} - {n} + 2.0D) / sqrt(fx + fy)")).alias("sum_balaban_index"),
    )
    out = None
    for row in (a, b, c):
        part = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), real(F.col(k)).alias("value")) for k in row.columns])).alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out


def edge_sides(g: Graph, table: DataFrame) -> DataFrame:
    """(eid, nu, nv): for each edge, the vertices strictly closer to its first and to its second end."""
    e = g.edges.where("src != dst").select("eid", "src", "dst")
    t = table.select("s", "t", "dist")
    near = e.join(t.select(F.col("s").alias("src"), F.col("t").alias("w"), F.col("dist").alias("a")), "src").join(t.select(F.col("s").alias("dst"), F.col("t").alias("w"), F.col("dist").alias("b")), ["dst", "w"])
    return near.groupBy("eid").agg(F.count_if(F.col("a") < F.col("b")).alias("nu"), F.count_if(F.col("b") < F.col("a")).alias("nv"))


def szeged_indices(g: Graph, table: DataFrame | None = None) -> DataFrame:
    """(name, value): szeged_index, vertex_pi_index, mostar_index, revised_szeged_index; without a table, once for all edges between two classes of twins."""
    n = g.vertices.count()
    if table is None and not g.directed:
        table, classes = class_distances(g)[:2]
        at = lambda end: classes.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
        e = g.edges.where("src != dst").select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.count("*").alias("m"))
        t = table.select("s", "t", "dist", "nt")
        near = e.join(t.select(F.col("s").alias("src"), F.col("t").alias("w"), F.col("dist").alias("a"), F.col("nt").alias("na")), "src").join(t.select(F.col("s").alias("dst"), F.col("t").alias("w"), F.col("dist").alias("b"), F.col("nt").alias("nb")), ["dst", "w"])
        # a class is split only by an end in it, whose other end sees it whole
        sides = near.groupBy("src", "dst", "m").agg(F.sum(F.expr("if(a < b, least(na, nb), 0L)")).alias("nu"), F.sum(F.expr("if(b < a, least(na, nb), 0L)")).alias("nv"))
    else:
        sides = edge_sides(g, store(distances(g)) if table is None else table).withColumn("m", F.lit(1).cast("long"))
    t = sides.agg(F.sum(F.expr("m * (nu * nv)")).alias("szeged_index"), F.sum(F.expr("m * (nu + nv)")).alias("vertex_pi_index"), F.sum(F.expr("m * abs(nu - nv)")).alias("mostar_index"), F.sum(F.expr(f"m * ((nu + ({n} - nu - nv) / 2.0D) * (nv + ({n} - nu - nv) / 2.0D))")).alias("revised_szeged_index"))
    return t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), real(F.col(k).cast("double")).alias("value")) for k in t.columns])).alias("p")).select("p.*")


def betweenness(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(v, betweenness), by dependency accumulation over the distance table, level by level from the farthest; halved if undirected. Without ``sources`` an undirected graph is searched from one of each class of twins."""
    classes = None
    if not g.directed and sources is None:
        table, classes, steps = class_distances(g)
    else:
        steps = g.slots.where("v != u").groupBy("v", "u").agg(F.count("*").alias("k"))
        table = distances(g, sources if sources is not None else g.vertices)
        table = store(table.withColumns({"ns": F.lit(1).cast("long"), "nt": F.lit(1).cast("long")}))
    steps = steps.select("v", "u", "k")
    depth = table.agg(F.max("dist")).first()[0] or 0
    parts = []
    lower = table.where(F.col("dist") == depth).select("s", "t", "paths", "ns", "nt", F.lit(0.0).alias("delta"))
    for level in range(depth - 1, -1, -1):
        here = table.where(F.col("dist") == level).select("s", "t", "paths", "ns", "nt")
        pushed = lower.select("s", F.col("t").alias("u"), (F.col("nt") * (1 + F.col("delta")) / F.col("paths")).alias("x")).join(steps, "u").select("s", F.col("v").alias("t"), (F.col("x") * F.col("k")).alias("x"))
        got = pushed.groupBy("s", "t").agg(F.sum("x").alias("x"))
        lower = store(here.join(got, ["s", "t"], "left").select("s", "t", "paths", "ns", "nt", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("delta")))
        if level:
            parts.append(lower.select("t", (F.col("ns") * F.col("delta")).alias("delta")))
    summed = None
    for p in parts:
        summed = p if summed is None else summed.unionByName(p)
    half = 1.0 if g.directed else 0.5
    if summed is None:
        return g.vertices.select("v", F.lit(0.0).alias("betweenness"))
    total = summed.groupBy(F.col("t").alias("v")).agg(F.sum("delta").alias("b"))
    if classes is not None:
        total = total.withColumnRenamed("v", "c").join(classes, "c").select("v", "b")
    return g.vertices.select("v").join(total, "v", "left").select("v", real(F.coalesce("b", F.lit(0.0)) * half).alias("betweenness"))
