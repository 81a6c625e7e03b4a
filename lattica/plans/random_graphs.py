"""Random graphs. Every draw is a hash of a seed and of what it decides, so a task that runs again, or on another machine, draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.graph import Graph, store


def uniform(*what: Column | int | str) -> Column:
    parts = [F.lit(x) if isinstance(x, (int, str)) else x for x in what]
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _vertices(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def erdos_renyi_gnp(spark: SparkSession, n: int, p: float, seed: int = 0, directed: bool = False) -> Graph:
    """Each pair with probability p. Every vertex skips ahead by geometric gaps, so the work follows the edges, not the pairs."""
    from lattica.plans.random_models import _with_ids, bernoulli_cells

    e = bernoulli_cells(spark, n, n, p, seed, "gnp", above=not directed).where("i != j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return Graph.from_edges(_with_ids(e, n), directed, _vertices(spark, n))


def erdos_renyi_gnm(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """m distinct pairs, every set equally likely: distinct numbers of pairs, pair number x being the x-th step round a circle of an odd number of vertices, or one to the vertex in its middle."""
    from lattica.plans.random_models import distinct_numbers

    around = n if n % 2 else n - 1
    x = distinct_numbers(spark, n * (n - 1) // 2, m, seed, "gnm")
    i, j = F.col("x") % max(around, 1), F.expr(f"x div {max(around, 1)}") + (1 if n % 2 else 0)
    other = F.when(j == 0, F.lit(n - 1)).otherwise((i + j) % max(around, 1)).cast("long")
    return Graph.from_edges(x.select(i.alias("src"), other.alias("dst")), False, _vertices(spark, n))


def random_geometric(spark: SparkSession, n: int, radius: float, seed: int = 0, torus: bool = False) -> Graph:
    """Points in the unit square, joined within the radius. A grid of cells as wide as the radius makes it an equi-join of neighbouring cells."""
    side = max(1, int(1 / radius))
    p = _vertices(spark, n).select("v", uniform(F.col("v"), 0, seed).alias("x"), uniform(F.col("v"), 1, seed).alias("y"))
    p = p.withColumns({"cx": F.floor(F.col("x") * side).cast("int"), "cy": F.floor(F.col("y") * side).cast("int")})
    near = F.explode(F.array_distinct(F.array(*[F.struct(*[(F.pmod(F.col(c) + d, F.lit(side)) if torus else F.col(c) + d).alias(c) for c, d in (("cx", i), ("cy", j))]) for i in (-1, 0, 1) for j in (-1, 0, 1)])))
    q = p.select(F.col("v").alias("u"), F.col("x").alias("x2"), F.col("y").alias("y2"), near.alias("c")).select("u", "x2", "y2", "c.cx", "c.cy")
    gap = (lambda a, b: F.least(F.abs(F.col(a) - F.col(b)), 1 - F.abs(F.col(a) - F.col(b)))) if torus else (lambda a, b: F.abs(F.col(a) - F.col(b)))
    e = p.join(q, ["cx", "cy"]).where((F.col("v") < F.col("u")) & (F.pow(gap("x", "x2"), 2) + F.pow(gap("y", "y2"), 2) <= radius**2))
    return Graph.from_edges(e.select(F.col("v").alias("src"), F.col("u").alias("dst")), False, _vertices(spark, n))


def configuration_model(degrees: DataFrame, seed: int = 0) -> Graph:
    """From (v, d) with an even sum: stubs in hashed order are paired; loops and parallel edges may come."""
    from pyspark.sql import Window

    stubs = degrees.where("d > 0").select("v", F.explode(F.sequence(F.lit(1), F.col("d").cast("int"))).alias("k")).withColumn("at", F.xxhash64("v", "k", F.lit(seed)))
    parts = max(1, degrees.agg(F.sum("d")).first()[0] // 100_000)
    stubs = stubs.withColumn("part", F.pmod("at", F.lit(parts)))
    ranked = stubs.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("at", "v", "k")) - 1)
    odd = ranked.groupBy("part").agg(F.max("i").alias("last")).where("last % 2 = 0")  # a stub without a partner in its part
    rest = ranked.join(odd, "part").where("i = last").select("v", F.row_number().over(Window.orderBy("at", "v")).alias("j"))
    first = ranked.join(odd, "part", "left").where("last is null or i != last").groupBy("part", F.expr("i div 2").alias("p")).agg(F.min("v").alias("src"), F.max("v").alias("dst")).select("src", "dst")
    second = rest.groupBy(F.expr("(j - 1) div 2").alias("p")).agg(F.min("v").alias("src"), F.max("v").alias("dst")).select("src", "dst")
    return Graph.from_edges(first.unionByName(second), False, degrees.select("v"))


def stochastic_block_model(spark: SparkSession, sizes: list[int], p: list[list[float]], seed: int = 0) -> Graph:
    """Blocks one after the other; pairs of blocks i and j with probability p[i][j]; rows skip ahead, so the work follows the edges."""
    from lattica.plans.random_models import sbm_game

    return sbm_game(spark, sizes, p, seed)


def watts_strogatz(spark: SparkSession, n: int, nei: int, p: float, seed: int = 0) -> Graph:
    """A ring with ``nei`` neighbours on each side, ends rewired with probability p, then loops and parallel edges dropped."""
    from lattica.operators.algebra import rewire_edges, simplify
    from lattica.plans.constructors import circulant

    g = circulant(spark, n, range(1, nei + 1))
    g = Graph.from_edges(g.edges.select("src", "dst", F.xxhash64("src", "dst").alias("eid")), False, g.vertices)
    return simplify(rewire_edges(g, p, seed, n))


def growing_graph(spark: SparkSession, n: int, m: int = 1, seed: int = 0, preferential: bool = True) -> Graph:
    """Vertex by vertex, m edges each to earlier ones. Preferential draws copy a random earlier slot (Bollobás and Riordan), so they need no
    history: a copied slot that is itself a copy is followed back by repeated halving of the slot number, as column arithmetic."""
    e = spark.range(m, n * m).select(F.col("id").alias("slot"))
    target = F.floor(uniform(F.col("slot"), 0, seed) * (F.col("slot") - F.col("slot") % m) * (2 if preferential else 1)).cast("long")
    if not preferential:
        return Graph.from_edges(e.select((F.col("slot") / m).cast("long").alias("src"), F.floor(target / m).cast("long").alias("dst"), F.col("slot").alias("eid")), True, _vertices(spark, n))
    # slot 2k is the source end of edge k, 2k + 1 its target end
    state = e.select("slot", target.alias("t"))
    while True:  # a slot is a copy with probability one half
        for _ in range(12):
            follow = F.when(F.col("t") % 2 == 0, F.col("t")).otherwise(F.when(F.floor(F.col("t") / 2) < m, F.lit(0).cast("long")).otherwise(F.floor(uniform(F.floor(F.col("t") / 2).cast("long"), 0, seed) * 2 * (F.floor(F.col("t") / 2) - F.floor(F.col("t") / 2) % m)).cast("long")))
            state = state.select("slot", follow.alias("t"))
        state = store(state)
        if state.where("t % 2 = 1").isEmpty():
            break
    return Graph.from_edges(state.select(F.floor(F.col("slot") / m).cast("long").alias("src"), F.floor(F.col("t") / 2 / m).cast("long").alias("dst"), F.col("slot").alias("eid")), True, _vertices(spark, n))
