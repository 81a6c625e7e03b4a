"""Small patterns in large graphs: induced subgraphs, embeddings, motifs, triads, and the graph classes they rule out.

A pattern grows vertex by vertex: each joins the neighbours of one found already, and what its other
neighbours and non-neighbours ask is a semi-join or an anti-join with the adjacency. Order constraints from
the pattern's own symmetries give every copy once, not once an automorphism. The rows are the copies, so
a frequent pattern is as large as its count; yes-or-no questions ask for one row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store

Pattern = tuple[int, list[tuple[int, int]]]

# The patterns by name, as their number of vertices and edges.
PATTERNS: dict[str, Pattern] = {
    "p3": (3, [(0, 1), (1, 2)]),
    "triangle": (3, [(0, 1), (1, 2), (0, 2)]),
    "claw": (4, [(0, 1), (0, 2), (0, 3)]),
    "p4": (4, [(0, 1), (1, 2), (2, 3)]),
    "c4": (4, [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "paw": (4, [(0, 1), (0, 2), (1, 2), (0, 3)]),
    "diamond": (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]),
    "k4": (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]),
    "p5": (5, [(0, 1), (1, 2), (2, 3), (3, 4)]),
    "c5": (5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)]),
    "bull": (5, [(0, 1), (0, 2), (1, 2), (0, 3), (1, 4)]),
    "gem": (5, [(0, 1), (1, 2), (2, 3), (4, 0), (4, 1), (4, 2), (4, 3)]),
    "house": (5, [(0, 1), (0, 2), (1, 2), (1, 3), (3, 4), (2, 4)]),
    "banner": (5, [(0, 1), (1, 2), (2, 3), (0, 3), (0, 4)]),
    "bowtie": (5, [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)]),
    "cricket": (5, [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4)]),
    "dart": (5, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 4)]),
    "fork": (5, [(0, 1), (0, 2), (0, 3), (3, 4)]),
    "net": (6, [(0, 1), (0, 2), (1, 2), (0, 3), (1, 4), (2, 5)]),
}


def automorphisms(pattern: Pattern) -> list[tuple[int, ...]]:
    n, edges = pattern
    kept = {frozenset(e) for e in edges}
    return [p for p in permutations(range(n)) if all(frozenset((p[a], p[b])) in kept for a, b in edges)]


def order_constraints(pattern: Pattern) -> list[tuple[int, int]]:
    """(i, j) with p_i < p_j: the first of each orbit under the automorphisms that fix all before it is the least."""
    group, out = automorphisms(pattern), []
    for i in range(pattern[0]):
        out += [(i, j) for j in {p[i] for p in group} if j != i]
        group = [p for p in group if p[i] == i]
    return out


def _sequence(pattern: Pattern) -> list[int]:
    """The vertices, each but the first next to an earlier one; those with most earlier neighbours first."""
    n, edges = pattern
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    order = [max(range(n), key=lambda i: len(near[i]))]
    while len(order) < n:
        order.append(max((i for i in range(n) if i not in order), key=lambda i: (len(near[i] & set(order)), len(near[i]))))
    return order


def embeddings(g: Graph, pattern: Pattern, induced: bool = True, once: bool = True) -> DataFrame:
    """(p0, p1, ...): where a connected pattern stands in the simple graph; induced or not, each copy once or once an automorphism."""
    n, edges = pattern
    adjacent = {frozenset(e) for e in edges}
    near = store(g.simple_slots if not g.directed else g.as_mode("all").simple_slots)
    order, less = _sequence(pattern), order_constraints(pattern) if once else []
    found = near.select(F.col("v").alias(f"p{order[0]}")).distinct()
    for k in range(1, n):
        new, old = order[k], order[:k]
        ties = [i for i in old if frozenset((i, new)) in adjacent]
        if not ties:
            raise ValueError("a pattern must be connected")
        found = found.join(near.select(F.col("v").alias(f"p{ties[0]}"), F.col("u").alias(f"p{new}")), f"p{ties[0]}")
        rules = [F.col(f"p{i}") != F.col(f"p{new}") for i in old]
        rules += [F.col(f"p{a}") < F.col(f"p{b}") for a, b in less if new in (a, b) and (a in old or b in old)]
        for rule in rules:
            found = found.where(rule)
        for i in old:
            edge = near.select(F.col("v").alias(f"p{i}"), F.col("u").alias(f"p{new}"))
            if i in ties[1:]:
                found = found.join(edge, [f"p{i}", f"p{new}"], "left_semi")
            elif i not in ties and induced:
                found = found.join(edge, [f"p{i}", f"p{new}"], "left_anti")
    return found.select(*[f"p{i}" for i in range(n)])


# Induced copies from the copies that need not be induced: w paths of three, t triangles, s claws, p paths of four, c cycles of four, q paws, d diamonds, k complete graphs of four.
SMALL = {
    "p3": "w - 3 * t", "triangle": "t", "k4": "k", "diamond": "d - 6 * k", "c4": "c - d + 3 * k", "paw": "q - 4 * d + 12 * k", "claw": "s - q + 2 * d - 4 * k", "p4": "p - 4 * c - 2 * q + 6 * d - 12 * k",
}


def _small_counts(g: Graph) -> DataFrame:
    """(w, t, s, p, c, q, d, k), see SMALL, of the simple graph whatever the edges' directions."""
    from lattica.operators.triangles import clustering, edge_support, list_triangles

    pairs = g.edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    g = Graph.from_edges(pairs, False, g.vertices)
    at, on = store(clustering(g).select("v", "degree", "triangles")), edge_support(g)
    by_vertex = at.agg(*[F.coalesce(F.sum(F.expr(x)), F.lit(0)).alias(n) for n, x in {"w": "degree * (degree - 1) div 2", "t3": "triangles", "s": "degree * (degree - 1) div 2 * (degree - 2) div 3", "q": "triangles * (degree - 2)"}.items()])
    by_edge = on.agg(F.coalesce(F.sum(F.expr("support * (support - 1) div 2")), F.lit(0)).alias("d"))
    slots = store(g.slots.select("v", "u").join(at.select("v", F.col("degree").alias("dv")), "v").join(at.select(F.col("v").alias("u"), F.col("degree").alias("du")), "u"))
    paths = slots.where("v < u").agg(F.coalesce(F.sum(F.expr("(dv - 1) * (du - 1)")), F.lit(0)).alias("p3"))
    # a cycle of four at its vertex of the highest degree, by the one across
    up = slots.where("dv < du or (dv = du and v < u)").select("v", F.col("u").alias("top"), F.col("du").alias("dt"))
    wedges = up.join(slots.select("v", F.col("u").alias("far"), F.col("du").alias("df")), "v").where("df < dt or (df = dt and far < top)")
    cycles = wedges.groupBy("top", "far").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("c"))
    t = store(list_triangles(g))
    fours = t.join(t.withColumnRenamed("c", "e"), ["a", "b"]).where("c < e").join(g.edges.select(F.col("src").alias("c"), F.col("dst").alias("e")), ["c", "e"], "left_semi").agg(F.count("*").alias("k"))
    row = by_vertex.withColumn("one", F.lit(1))
    for other in (by_edge, paths, cycles, fours):
        row = row.join(F.broadcast(other.withColumn("one", F.lit(1))), "one")  # one row
    return row.select("w", F.expr("t3 div 3").alias("t"), "s", F.expr("p3 - t3").alias("p"), "c", "q", "d", "k")


def pattern_counts(g: Graph, names: list[str]) -> DataFrame:
    """(name, copies): induced copies of each named pattern; those of up to four vertices are counted from degrees, triangles and wedges, not listed."""
    out = None
    small = [x for x in names if x in SMALL]
    if small:
        row = _small_counts(g)
        out = row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.expr(SMALL[x]).cast("long").alias("copies")) for x in small])).alias("p")).select("p.*")
    for name in names:
        if name in SMALL:
            continue
        row = embeddings(g, PATTERNS[name]).agg(F.count("*").alias("copies")).select(F.lit(name).alias("name"), "copies")
        out = row if out is None else out.unionByName(row)
    return out


def contains(g: Graph, pattern: Pattern, induced: bool = True) -> bool:
    """Whether a copy exists, which is also whether ``pattern`` is (induced-)subisomorphic to the graph."""
    return not embeddings(g, pattern, induced).isEmpty()


# Which patterns a class forbids.
FORBIDDEN: dict[str, list[str]] = {f"is_{x}_free": [x] for x in ("claw", "c4", "paw", "diamond", "p5", "c5", "bull", "gem", "house", "banner", "bowtie", "cricket", "dart", "fork", "net")}
FORBIDDEN |= {"is_cluster_graph": ["p3"], "is_cograph": ["p4"], "is_trivially_perfect": ["p4", "c4"], "is_triangle_free_graph": ["triangle"]}


def forbidden_classes(g: Graph) -> DataFrame:
    """(name, value): membership in the classes that forbid induced patterns; false for directed graphs. Each pattern is looked for once."""
    found = {x: g.directed or contains(g, PATTERNS[x]) for x in sorted({p for ps in FORBIDDEN.values() for p in ps})}
    rows = [(name, not g.directed and not any(found[p] for p in ps)) for name, ps in FORBIDDEN.items()]
    return g.spark.createDataFrame(rows, "name string, value boolean")


def motifs(g: Graph, size: int = 3) -> DataFrame:
    """(name, copies): induced copies of the connected undirected graphs of 3 or 4 vertices."""
    if size not in (3, 4):
        raise ValueError("motifs have 3 or 4 vertices")
    return pattern_counts(g, ["p3", "triangle"] if size == 3 else ["claw", "p4", "c4", "paw", "diamond", "k4"])


def count_isomorphisms(g: Graph, other: Pattern) -> int:
    """How many ways a small connected graph maps onto ``g``, edges onto edges; 0 if they differ."""
    if g.vertices.count() != other[0] or g.simple_slots.count() != 2 * len({frozenset(e) for e in other[1]}):
        return 0
    return embeddings(g, other, True, False).count()


def _triad_names() -> dict[int, str]:
    """The census class of a triad a, b, c from the two-bit states of (a, b), (a, c), (b, c): 1 there, 2 back, 3 both."""
    out = {}
    for code in range(64):
        arcs = set()
        for k, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
            state = code >> 2 * k & 3
            arcs |= {(x, y)} if state & 1 else set()
            arcs |= {(y, x)} if state & 2 else set()
        mutual = {frozenset(e) for e in arcs if e[::-1] in arcs}
        single = [e for e in arcs if e[::-1] not in arcs]
        name = f"{len(mutual)}{len(single)}{3 - len(mutual) - len(single)}"
        outs, ins = [sum(e[0] == v for e in single) for v in range(3)], [sum(e[1] == v for e in single) for v in range(3)]
        if name in ("021", "120"):
            name += "D" if 2 in outs else "U" if 2 in ins else "C"
        elif name == "111":
            name += "D" if single[0][1] in next(iter(mutual)) else "U"
        elif name == "030":
            name += "C" if max(outs) == 1 else "T"
        out[code] = name
    return out


def triad_census(g: Graph) -> DataFrame:
    """(name, triads): how many triples of vertices are of each of the 16 directed classes.

    Triples with two or three linked pairs are listed from a linked pair's end, triples with one follow from
    the neighbourhood of each linked pair, and the rest are empty. Undirected edges count as mutual.
    """
    n = g.vertices.count()
    arcs = g.slots.where("v != u").select("v", "u").distinct()
    ways = arcs.withColumn("x", F.lit(1)).unionByName(arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.lit(2).alias("x")))
    state = store(ways.groupBy("v", "u").agg(F.sum("x").cast("int").alias("x")))  # from either end
    # m in the middle, a < b its neighbours; a triple that is closed is met three times and taken where m is least
    wedge = state.select(F.col("v").alias("m"), F.col("u").alias("a"), F.col("x").alias("ma")).join(state.select(F.col("v").alias("m"), F.col("u").alias("b"), F.col("x").alias("mb")), "m").where("a < b")
    closed = wedge.join(state.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("x").alias("ab")), ["a", "b"], "left").where("ab is null or m < a")
    names = F.create_map(*[F.lit(x) for code, name in _triad_names().items() for x in (code, name)])
    listed = closed.groupBy((F.col("ma") + 4 * F.col("mb") + 16 * F.coalesce("ab", F.lit(0))).alias("code")).agg(F.count("*").alias("k")).select(names[F.col("code")].alias("name"), "k")
    # a linked pair makes a triad of one pair with every vertex that neither end is linked to
    d = state.groupBy("v").agg(F.count("*").alias("d"))
    pairs = state.where("v < u").join(d, "v").join(d.select(F.col("v").alias("u"), F.col("d").alias("e")), "u")
    common = wedge.groupBy("a", "b").agg(F.count("*").alias("common"))
    lone = pairs.join(common, (F.col("v") == F.col("a")) & (F.col("u") == F.col("b")), "left").select(
        F.when(F.col("x") == 3, "102").otherwise("012").alias("name"), (F.lit(n) - 2 - (F.col("d") - 1) - (F.col("e") - 1) + F.coalesce("common", F.lit(0))).alias("k")
    )
    known = listed.unionByName(lone).groupBy("name").agg(F.sum("k").alias("k"))
    every = g.spark.createDataFrame([(x,) for x in sorted(set(_triad_names().values()))], "name string")
    known = store(every.join(known, "name", "left").select("name", F.coalesce("k", F.lit(0)).cast("long").alias("triads")))
    rest = n * (n - 1) * (n - 2) // 6 - (known.agg(F.sum("triads")).first()[0] or 0)
    return known.select("name", F.when(F.col("name") == "003", F.lit(rest)).otherwise(F.col("triads")).cast("long").alias("triads"))


def ecc(g: Graph, k: int = 3, offset: bool = False, normalize: bool = True) -> DataFrame:
    """(a, b, ecc): the edge clustering coefficient of order 3: triangles on the edge, over the most that the lower degree allows."""
    from lattica.operators.triangles import edge_support

    if k != 3:
        raise ValueError("only triangles (k = 3) are counted")
    d = g.degrees()
    s = edge_support(g).join(d.select(F.col("v").alias("a"), F.col("d").alias("x")), "a").join(d.select(F.col("v").alias("b"), F.col("d").alias("y")), "b")
    value = F.col("support") + F.lit(1.0 if offset else 0.0)
    return s.select("a", "b", (value / F.expr("nullif(least(x, y) - 1, 0)") if normalize else value).cast("double").alias("ecc"))
