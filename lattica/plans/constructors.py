"""Deterministic graphs, as column arithmetic over ranges: edges are never listed on the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def _from(spark: SparkSession, n: int, count: int, src: str, dst: str, directed: bool, where: str = "true", **more: int) -> Graph:
    """Edges (src, dst), SQL over ``id`` in 0..count-1, the edge id unless ``where`` drops rows."""
    e = spark.range(count).where(where).selectExpr(f"cast({src} as long) as src", f"cast({dst} as long) as dst", "id as eid")
    return Graph.from_edges(e, directed, _vertices(spark, n))


def path_graph(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    return _from(spark, n, max(n - 1, 0), "id", "id + 1", directed)


def ring_graph(spark: SparkSession, n: int, directed: bool = False) -> Graph:
    return _from(spark, n, n, "id", f"(id + 1) % {n}", directed)


def star_graph(spark: SparkSession, n: int, directed: bool = False, centre: int = 0) -> Graph:
    return _from(spark, n, n, f"{centre}", "id", directed, f"id != {centre}")


def wheel_graph(spark: SparkSession, n: int) -> Graph:
    """A centre 0 joined to a ring 1..n-1."""
    ring = n - 1
    return _from(spark, n, 2 * ring, f"case when id < {ring} then 0 else id - {ring} + 1 end", f"case when id < {ring} then id + 1 else (id - {ring} + 1) % {ring} + 1 end", False)


def full_graph(spark: SparkSession, n: int, directed: bool = False, loops: bool = False) -> Graph:
    keep = "true" if loops else f"id div {n} != id % {n}"
    if not directed:
        keep += f" and id div {n} <= id % {n}"
    return _from(spark, n, n * n, f"id div {n}", f"id % {n}", directed, keep)


def full_citation(spark: SparkSession, n: int, directed: bool = True) -> Graph:
    """Every vertex points at all before it."""
    return _from(spark, n, n * n, f"id div {n}", f"id % {n}", directed, f"id div {n} > id % {n}")


def full_multipartite(spark: SparkSession, sizes: list[int]) -> Graph:
    """Parts of the given sizes, one after the other; an edge between any two vertices of different parts."""
    n = sum(sizes)
    bounds = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    part = lambda x: "case " + " ".join(f"when {x} < {b} then {i}" for i, b in enumerate(bounds)) + " end" if bounds else "0"
    a, b = f"(id div {max(n, 1)})", f"(id % {max(n, 1)})"
    return _from(spark, n, n * n, a, b, False, f"{a} < {b} and ({part(a)}) != ({part(b)})")


def full_bipartite(spark: SparkSession, n1: int, n2: int) -> Graph:
    return full_multipartite(spark, [n1, n2])


def turan_graph(spark: SparkSession, n: int, r: int) -> Graph:
    """The complete r-partite graph with parts as equal as can be, larger parts first."""
    return full_multipartite(spark, [n // r + (i < n % r) for i in range(r)])


def kary_tree(spark: SparkSession, n: int, children: int, directed: bool = False) -> Graph:
    return _from(spark, n, max(n - 1, 0), f"id div {children}", "id + 1", directed)


def symmetric_tree(spark: SparkSession, branches: list[int], directed: bool = False) -> Graph:
    """Level i's vertices have branches[i] children each, numbered level by level."""
    edges, first, width = None, 0, 1
    for b in branches:
        level = spark.range(width * b).selectExpr(f"{first} + id div {b} as src", f"{first + width} + id as dst")
        edges = level if edges is None else edges.unionByName(level)
        first, width = first + width, width * b
    n = first + width
    return Graph.from_edges(edges if edges is not None else spark.range(0).selectExpr("id as src", "id as dst"), directed, _vertices(spark, n))


def regular_tree(spark: SparkSession, height: int, degree: int, directed: bool = False) -> Graph:
    return symmetric_tree(spark, [degree] + [degree - 1] * (height - 1), directed)


def square_lattice(spark: SparkSession, dims: list[int], circular: bool = False, directed: bool = False) -> Graph:
    """A grid of the given sides, the first side's coordinate varying fastest."""
    n, stride, edges = 1, 1, None
    for d in dims:
        n *= d
    for d in dims:
        at = f"(id div {stride}) % {d}"
        part = spark.range(n).where(f"{at} < {d - 1}").selectExpr("id as src", f"id + {stride} as dst")
        if circular and d > 1 and not (d == 2 and not directed):
            part = part.unionByName(spark.range(n).where(f"{at} = {d - 1}").selectExpr("id as src", f"id - {stride * (d - 1)} as dst"))
        edges = part if edges is None else edges.unionByName(part)
        stride *= d
    return Graph.from_edges(edges, directed, _vertices(spark, n))


def triangular_lattice(spark: SparkSession, rows: int, cols: int) -> Graph:
    """A grid with one diagonal in each cell."""
    n = rows * cols
    parts = [("true", f"id % {cols} < {cols - 1}", "id + 1"), ("true", f"id < {n - cols}", f"id + {cols}"), ("true", f"id % {cols} > 0 and id < {n - cols}", f"id + {cols - 1}")]
    edges = None
    for _, keep, to in parts:
        e = spark.range(n).where(keep).selectExpr("id as src", f"{to} as dst")
        edges = e if edges is None else edges.unionByName(e)
    return Graph.from_edges(edges, False, _vertices(spark, n))


def hypercube(spark: SparkSession, dimension: int) -> Graph:
    n = 1 << dimension
    return _from(spark, n, n * dimension, f"id div {max(dimension, 1)}", f"(id div {max(dimension, 1)}) ^ shiftleft(1L, cast(id % {max(dimension, 1)} as int))", False, f"((id div {max(dimension, 1)}) & shiftleft(1L, cast(id % {max(dimension, 1)} as int))) = 0")


def hamming_graph(spark: SparkSession, d: int, q: int) -> Graph:
    """Words of length d over q letters, joined where they differ in one place."""
    n, edges = q**d, None
    for i in range(d):
        p = q**i
        e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("c")).selectExpr("src", f"src + (c - (src div {p}) % {q}) * {p} as dst").where("src < dst")
        edges = e if edges is None else edges.unionByName(e)
    return Graph.from_edges(edges, False, _vertices(spark, n))


def circulant(spark: SparkSession, n: int, shifts: Iterable[int], directed: bool = False) -> Graph:
    """Vertex i joined to i + s for each shift s; shifts that give the same undirected edges count once."""
    kept: list[int] = []
    for s in shifts:
        s %= n
        if s and s not in kept and (directed or n - s not in kept):
            kept.append(s)
    edges = None
    for s in kept:
        e = spark.range(n if directed or 2 * s != n else n // 2).selectExpr("id as src", f"(id + {s}) % {n} as dst")
        edges = e if edges is None else edges.unionByName(e)
    return Graph.from_edges(edges if edges is not None else spark.range(0).selectExpr("id as src", "id as dst"), directed, _vertices(spark, n))


def generalized_petersen(spark: SparkSession, n: int, k: int) -> Graph:
    return _from(spark, 2 * n, 3 * n, f"case when id < {2 * n} then id % {n} else id - {n} end", f"case when id < {n} then (id + 1) % {n} when id < {2 * n} then id else {n} + (id - {2 * n} + {k}) % {n} end", False)


def de_bruijn(spark: SparkSession, m: int, k: int) -> Graph:
    """Words of length k over m letters; an edge for each shift by one letter."""
    n = m**k
    return _from(spark, n, n * m, f"id div {m}", f"(id div {m} * {m}) % {n} + id % {m}", True)


def kautz(spark: SparkSession, m: int, k: int) -> Graph:
    """Words of length k + 1 over m + 1 letters without equal neighbours, numbered in order; edges shift by one letter.

    A word is its first letter and k steps of 1..m from letter to letter, so shifting it is arithmetic.
    """
    n = (m + 1) * m**k
    tail = m**k
    first_step = f"((id div {m}) % {tail}) div {max(tail // m, 1)}" if k else "0"
    return _from(spark, n, n * m, f"id div {m}", f"(((id div {m}) div {tail} + 1 + {first_step}) % {m + 1}) * {tail} + (((id div {m}) % {tail}) * {m}) % {tail} + id % {m}" if k else f"(id div {m} + 1 + id % {m}) % {m + 1}", True)


def lcf_graph(spark: SparkSession, n: int, shifts: list[int], repeats: int) -> Graph:
    """A ring with chords: vertex i has the chord of length shifts[i mod len]; chords named from both ends count once."""
    table = F.array(*[F.lit(s) for s in shifts])
    i = F.col("id")
    chords = spark.range(min(n, len(shifts) * repeats)).select(i.alias("a"), F.pmod(i + F.get(table, (i % len(shifts)).cast("int")), F.lit(n)).cast("long").alias("b")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    ring = ring_graph(spark, n).edges.select("src", "dst")
    return Graph.from_edges(ring.unionByName(chords).distinct(), False, _vertices(spark, n))


def from_prufer(spark: SparkSession, code: list[int]) -> Graph:
    """The labelled tree of a Prüfer code; decoding is sequential, so it is done on the driver."""
    import heapq

    n = len(code) + 2
    left = [1] * n
    for x in code:
        left[x] += 1
    leaves = [i for i in range(n) if left[i] == 1]
    heapq.heapify(leaves)
    edges = []
    for x in code:
        leaf = heapq.heappop(leaves)
        edges.append((leaf, x))
        left[x] -= 1
        if left[x] == 1:
            heapq.heappush(leaves, x)
    edges.append((heapq.heappop(leaves), heapq.heappop(leaves)))
    return Graph.from_lists(spark, n, edges)


def tree_from_parents(parents: DataFrame, directed: bool = False) -> Graph:
    """From (v, parent), null for roots."""
    return Graph.from_edges(parents.where("parent is not null").select(F.col("parent").alias("src"), F.col("v").alias("dst")), directed, parents.select("v"))


def from_adjacency(matrix: DataFrame, directed: bool = True, n: int | None = None) -> Graph:
    """From (i, j, count): an edge for each count; the upper triangle if undirected."""
    m = matrix if directed else matrix.where("i <= j")
    e = m.where("count > 0").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_")).select("src", "dst")
    return Graph.from_edges(e, directed, _vertices(matrix.sparkSession, n) if n is not None else None)


def mycielskian(g: Graph, n: int) -> Graph:
    """Of a graph on 0..n-1: a shadow n + v of each v joined to v's neighbours, and 2n joined to all shadows."""
    e = g.edges.select("src", "dst")
    edges = e.unionByName(e.selectExpr("src", f"dst + {n} as dst")).unionByName(e.selectExpr(f"src + {n} as src", "dst")).unionByName(g.vertices.selectExpr(f"v + {n} as src", f"cast({2 * n} as long) as dst"))
    return Graph.from_edges(edges, False, _vertices(g.spark, 2 * n + 1))
