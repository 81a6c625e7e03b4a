"""Further random graphs, and edges drawn or held out. Every draw is a hash of a seed and of what it decides."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.plans.random_graphs import _vertices, uniform
from lattica.shipping import ship


#: Places drawn at once.
DRAWS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(key: int, i: np.ndarray, k: np.ndarray) -> np.ndarray:
    """In (0, 1), a hash of the key and of two numbers."""
    x = _mixed(_mixed(i.astype(np.uint64) + np.uint64(key)) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _key(*what) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), digest_size=8).digest(), "big")


def _cells(ids: np.ndarray, columns: int, p: float, key: int, above: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), in order, of some rows at a time: each cell with probability 0 < p < 1, only j > i if ``above``."""
    while len(ids):
        width = columns - int(ids.min()) if above else columns
        most = min(columns, int(width * p + 12 * math.sqrt(width * p * (1 - p) + 1) + 12))
        now, ids = ids[: max(1, DRAWS // most)], ids[max(1, DRAWS // most) :]
        gaps = np.floor(np.log(_uniform(key, now[:, None], np.arange(most)[None, :])) / math.log1p(-p))
        j = np.cumsum(np.minimum(gaps, columns).astype(np.int64) + 1, axis=1) + (now[:, None] if above else -1)
        row, place = np.nonzero(j < columns)
        yield now[row], j[row, place]


def _by_rows(spark: SparkSession, rows: int, mean: float, cells: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(i, j) of ``cells`` of the rows' numbers."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in cells(batch.column(0).to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"])

    tasks = int(min(10_000, rows, 1 + rows * mean // (4 * DRAWS)))
    return spark.range(0, rows, 1, max(1, tasks)).mapInArrow(run, "i long, j long")


def bernoulli_cells(spark: SparkSession, rows: int, columns: int, p: float, *key, above: bool = False) -> DataFrame:
    """(i, j): each cell of a rows by columns table with probability p, only j > i if ``above``. A row skips ahead by geometric gaps, so the work follows the cells drawn.

    A row may draw up to 12 standard deviations more than its mean, which it exceeds with a chance far under 1e-20.
    """
    if p <= 0 or not rows or not columns:
        return spark.range(0).selectExpr("id as i", "id as j")
    if p >= 1:
        cells = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).alias("j"))
        return cells.where("i < j") if above else cells
    number = _key(*key)
    return _by_rows(spark, rows, columns * p, lambda ids: _cells(ids, columns, p, number, above))


def sbm_game(spark: SparkSession, sizes: list[int], p: list[list[float]], seed: int = 0, directed: bool = False) -> Graph:
    """Blocks one after the other; pairs of vertices of blocks i and j with probability p[i][j]."""
    starts, edges = [sum(sizes[:i]) for i in range(len(sizes))], spark.range(0).selectExpr("id as src", "id as dst")
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes):
            if directed or i <= j:
                cells = bernoulli_cells(spark, a, b, p[i][j], seed, i, j, above=i == j and not directed).select((F.col("i") + starts[i]).alias("src"), (F.col("j") + starts[j]).alias("dst"))
                edges = edges.unionByName(cells.where("src != dst"))
    return Graph.from_edges(_with_ids(edges, sum(sizes)), directed, _vertices(spark, sum(sizes)))


def _with_ids(e: DataFrame, n: int) -> DataFrame:
    """Simple edges of vertices 0 .. n - 1, numbered by their ends: nothing has to be written."""
    return e.withColumn("eid", F.col("src") * n + F.col("dst"))


def hsbm_game(spark: SparkSession, blocks: int, size: int, sizes: list[int], p: list[list[float]], between: float, seed: int = 0) -> Graph:
    """``blocks`` copies of a block model of ``size`` vertices, and pairs of different copies with probability ``between``."""
    if sum(sizes) != size:
        raise ValueError("the inner blocks don't sum to the size")
    edges = spark.range(0).selectExpr("id as src", "id as dst")
    for k in range(blocks):
        inner = sbm_game(spark, sizes, p, seed + 1 + k).edges.select((F.col("src") + k * size).alias("src"), (F.col("dst") + k * size).alias("dst"))
        outer = bernoulli_cells(spark, size, (blocks - 1 - k) * size, between, seed, "between", k).select((F.col("i") + k * size).alias("src"), (F.col("j") + (k + 1) * size).alias("dst"))
        edges = edges.unionByName(inner).unionByName(outer)
    return Graph.from_edges(edges, False, _vertices(spark, blocks * size))


def bipartite_game_gnp(spark: SparkSession, n1: int, n2: int, p: float, seed: int = 0) -> Graph:
    """Vertices 0 .. n1 - 1 and the n2 after them; each pair across with probability p."""
    e = bernoulli_cells(spark, n1, n2, p, seed, "bipartite").select(F.col("i").alias("src"), (F.col("j") + n1).alias("dst"))
    return Graph.from_edges(e, False, _vertices(spark, n1 + n2))


def distinct_numbers(spark: SparkSession, total: int, m: int, *key) -> DataFrame:
    """(x): m distinct numbers under ``total``, every set equally likely: draws are repeated for those that came before."""
    if m > total:
        raise ValueError("more than there are")
    if 2 * m > total:  # the complement is the smaller set
        left = distinct_numbers(spark, total, total - m, *key)
        return spark.range(total).select(F.col("id").alias("x")).join(left, "x", "left_anti")
    if not m:
        return spark.range(0).selectExpr("id as x")
    found, turn = None, 0
    while True:
        have = 0 if found is None else found.count()
        if have == m:
            return found
        drawn = spark.range(m - have).select(F.floor(uniform(F.col("id"), turn, *key) * total).cast("long").alias("x")).distinct()
        found = store(drawn if found is None else found.unionByName(drawn).distinct())
        turn += 1


def bipartite_game_gnm(spark: SparkSession, n1: int, n2: int, m: int, seed: int = 0) -> Graph:
    """m distinct pairs across."""
    e = distinct_numbers(spark, n1 * n2, m, seed, "gnm").select(F.expr(f"x div {n2}").alias("src"), (F.col("x") % n2 + n1).alias("dst"))
    return Graph.from_edges(e, False, _vertices(spark, n1 + n2))


def bipartite_iea_game(spark: SparkSession, n1: int, n2: int, m: int, seed: int = 0) -> Graph:
    """m pairs across, drawn independently: parallel edges may come."""
    e = spark.range(m).select(F.col("id").alias("eid"), F.floor(uniform(F.col("id"), 0, seed) * n1).cast("long").alias("src"), (F.floor(uniform(F.col("id"), 1, seed) * n2) + n1).cast("long").alias("dst"))
    return Graph.from_edges(e, False, _vertices(spark, n1 + n2))


def iea_game(spark: SparkSession, n: int, m: int, seed: int = 0, directed: bool = False, loops: bool = True) -> Graph:
    """m pairs drawn independently, of all or of distinct vertices."""
    src = F.floor(uniform(F.col("id"), 0, seed) * n).cast("long")
    dst = F.floor(uniform(F.col("id"), 1, seed) * (n if loops else n - 1)).cast("long")
    e = spark.range(m).select(F.col("id").alias("eid"), src.alias("src"), (dst if loops else dst + F.when(dst >= src, 1).otherwise(0)).alias("dst"))
    return Graph.from_edges(e, directed, _vertices(spark, n))


def tree_game_prufer(spark: SparkSession, n: int, seed: int = 0) -> Graph:
    """A labelled tree, each equally likely, from a drawn Prüfer sequence (decoded in one task: n numbers)."""
    from lattica.plans.constructors import from_prufer

    if n < 3:
        e = spark.range(max(0, n - 1)).selectExpr("id as src", "id + 1 as dst")
        return Graph.from_edges(e, False, _vertices(spark, n))
    drawn = spark.range(n - 2).select("id", F.floor(uniform(F.col("id"), seed, "tree") * n).cast("long").alias("x")).orderBy("id").collect()
    return from_prufer(spark, [r.x for r in drawn])


def islands_game(spark: SparkSession, islands: int, size: int, p: float, links: int, seed: int = 0) -> Graph:
    """Islands of ``size`` vertices with pairs inside with probability p, and ``links`` distinct pairs between each two islands."""
    edges = None
    for k in range(islands):
        inner = bernoulli_cells(spark, size, size, p, seed, "island", k).where("i < j").select((F.col("i") + k * size).alias("src"), (F.col("j") + k * size).alias("dst"))
        edges = inner if edges is None else edges.unionByName(inner)
        for j in range(k):
            across = distinct_numbers(spark, size * size, links, seed, "bridge", k, j).select((F.expr(f"x div {size}") + j * size).alias("src"), (F.col("x") % size + k * size).alias("dst"))
            edges = edges.unionByName(across)
    return Graph.from_edges(edges, False, _vertices(spark, islands * size))


def preference_game(spark: SparkSession, n: int, shares: list[float], p: list[list[float]], seed: int = 0, directed: bool = False) -> tuple[Graph, DataFrame]:
    """Vertices of drawn types (v, type), pairs with the probability of their types. Rows skip ahead by the largest probability, and cells are kept by their own over it."""
    total, edge = sum(shares), [sum(shares[: i + 1]) for i in range(len(shares))]

    def kind(v: str) -> Column:
        u, out = uniform(F.col(v), "type", seed) * total, F.lit(len(shares) - 1)
        for i in range(len(shares) - 2, -1, -1):
            out = F.when(u < edge[i], i).otherwise(out)
        return out.cast("int")

    types = store(_vertices(spark, n).select("v", kind("v").alias("type")))
    top = max(max(r) for r in p)
    cells = bernoulli_cells(spark, n, n, top, seed, "preference", above=not directed).where("i != j")
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in p])
    e = cells.withColumns({"a": kind("i"), "b": kind("j")})
    e = e.where(uniform(F.col("i"), F.col("j"), "kept", seed) * top < F.get(F.get(matrix, F.col("a")), F.col("b"))).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return Graph.from_edges(_with_ids(e, n), directed, types.select("v")), types


def chung_lu_game(spark: SparkSession, weights: list[float], seed: int = 0) -> Graph:
    """Pairs with probability min(1, w_i w_j / sum w), a vertex with itself with w_i^2 / (2 sum w). By classes of equal weight, so rows of a class skip ahead together."""
    total, classes = sum(weights), {}
    for v, w in enumerate(weights):
        classes.setdefault(w, []).append(v)
    members = spark.createDataFrame([(k, i, v) for k, vs in enumerate(classes.values()) for i, v in enumerate(vs)], "k int, i long, v long")
    values, edges = list(classes), None
    for a, x in enumerate(values):
        for b, y in list(enumerate(values))[a:]:
            p = min(1.0, x * y / total)
            cells = bernoulli_cells(spark, len(classes[x]), len(classes[y]), p, seed, a, b)
            if a == b:
                cells = cells.where("i < j").unionByName(spark.range(len(classes[x])).where(uniform(F.col("id"), "loop", a, seed) < p / 2).select(F.col("id").alias("i"), F.col("id").alias("j")))
            cells = cells.select(F.lit(a).alias("ka"), "i", F.lit(b).alias("kb"), "j")
            edges = cells if edges is None else edges.unionByName(cells)
    e = edges.join(members.select(F.col("k").alias("ka"), "i", F.col("v").alias("src")), ["ka", "i"]).join(members.select(F.col("k").alias("kb"), F.col("i").alias("j"), F.col("v").alias("dst")), ["kb", "j"])
    return Graph.from_edges(e.select("src", "dst"), False, _vertices(spark, len(weights)))


def static_fitness_game(fitness: DataFrame, m: int, seed: int = 0, loops: bool = False, multiple: bool = False) -> Graph:
    """m edges whose ends are drawn by fitness (v, fitness); those that aren't allowed are drawn again.

    A draw is a place along the running sum of fitness, found by a join on blocks of the sum.
    """
    spark = fitness.sparkSession
    total = fitness.agg(F.sum("fitness")).first()[0]
    parts = fitness.where("fitness > 0").select("v", F.col("fitness").cast("double").alias("f")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(256)))
    inside = parts.withColumn("top", F.sum("f").over(Window.partitionBy("part").orderBy("v")))
    before = parts.groupBy("part").agg(F.sum("f").alias("s")).withColumn("base", F.sum("s").over(Window.orderBy("part")) - F.col("s"))  # 256 rows
    places = store(inside.join(F.broadcast(before.select("part", "base")), "part").select("v", (F.col("base") + F.col("top") - F.col("f")).alias("low"), (F.col("base") + F.col("top")).alias("high")))  # 256 rows
    n = max(1, places.count())
    cell = total / n
    places = places.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))))
    found, turn = None, 0
    while True:
        have = 0 if found is None else found.count()
        if have >= m:
            break
        draws = spark.range(2 * (m - have)).select(F.col("id").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("at", uniform(F.col("k"), F.col("side"), turn, seed) * total).withColumn("cell", F.floor(F.col("at") / cell))
        ends = draws.join(places, "cell").where("at >= low and at < high").groupBy("k").agg(F.max(F.expr("case when side = 0 then v end")).alias("a"), F.max(F.expr("case when side = 1 then v end")).alias("b")).where("a is not null and b is not null")
        new = ends.where("a != b" if not loops else "true").select(F.lit(turn).alias("turn"), "k", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        found = new if found is None else found.unionByName(new)
        found = store(found if multiple else found.groupBy("src", "dst").agg(F.min(F.struct("turn", "k")).alias("o")).select("o.turn", "o.k", "src", "dst"))
        turn += 1
    last = found.select("turn", "k").orderBy("turn", "k").offset(m).limit(1).first() if found is not None and found.count() > m else None
    if last is not None:
        found = found.where((F.col("turn") < last.turn) | ((F.col("turn") == last.turn) & (F.col("k") < last.k)))
    return Graph.from_edges(found.select("src", "dst"), False, fitness.select("v"))


def static_power_law_game(spark: SparkSession, n: int, m: int, exponent: float, seed: int = 0) -> Graph:
    """static_fitness_game with fitness (v + 1)^(-1 / (exponent - 1)), so degrees follow a power law."""
    return static_fitness_game(_vertices(spark, n).select("v", F.pow(F.col("v") + 1.0, -1.0 / (exponent - 1)).alias("fitness")), m, seed)


def dot_product_game(vectors: DataFrame, seed: int = 0, directed: bool = False) -> Graph:
    """Pairs with the dot product of their vectors (v, x), cut to between 0 and 1, as probability; all pairs are looked at."""
    y = vectors.select(F.col("v").alias("u"), F.col("x").alias("y"))
    pairs = vectors.join(y, (F.col("v") != F.col("u")) if directed else (F.col("v") < F.col("u")))
    p = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return Graph.from_edges(pairs.where(uniform(F.col("v"), F.col("u"), seed) < p).select(F.col("v").alias("src"), F.col("u").alias("dst")), directed, vectors.select("v"))


def correlated_game(g: Graph, correlation: float, p: float, seed: int = 0) -> Graph:
    """A graph of density p whose edges are correlated with those of ``g``: an edge stays with p + correlation (1 - p), a pair without one gets it with p (1 - correlation)."""
    n = g.vertices.count()
    kept = g.edges.select("src", "dst").distinct().where(uniform(F.col("src"), F.col("dst"), "kept", seed) < p + correlation * (1 - p))
    numbers = store(g.vertices.select("v", (F.row_number().over(Window.orderBy("v")) - 1).alias("i")))  # the vertices in one task
    new = bernoulli_cells(g.spark, n, n, p * (1 - correlation), seed, "new").where("i != j" if g.directed else "i < j")
    new = new.join(numbers.select("i", F.col("v").alias("src")), "i").join(numbers.select(F.col("i").alias("j"), F.col("v").alias("dst")), "j").select("src", "dst")
    return Graph.from_edges(kept.unionByName(new.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")), g.directed, g.vertices)


def correlated_pair_game(spark: SparkSession, n: int, correlation: float, p: float, seed: int = 0) -> tuple[Graph, Graph]:
    """Two random graphs as of correlated_game(). A row of the second is drawn beside the same row of the first, so no edges are joined."""
    from lattica.plans.random_graphs import erdos_renyi_gnp

    first = erdos_renyi_gnp(spark, n, p, seed)
    if not 0 < p < 1 or not 0 < p * (1 - correlation) < 1:
        return first, correlated_game(first, correlation, p, seed + 1)
    there, kept, more = _key(seed, "gnp"), _key(seed, "kept"), _key(seed, "new")

    def cells(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = max(1, int(DRAWS // (n * p + 1)))
        for some in (ids[k : k + size] for k in range(0, len(ids), size)):
            old, new = (np.concatenate([i * n + j for i, j in _cells(some, n, q, key, True)]) for q, key in ((p, there), (p * (1 - correlation), more)))
            stay = old[_uniform(kept, old // n, old % n) < p + correlation * (1 - p)]
            e = np.concatenate([stay, np.setdiff1d(new, old, assume_unique=True)])
            yield e // n, e % n

    e = _by_rows(spark, n, n * p, cells).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    return first, Graph.from_edges(_with_ids(e, n), False, first.vertices)


def sample_negative_edges(g: Graph, m: int, seed: int = 0, excluded: DataFrame | None = None, biased: bool = False) -> DataFrame:
    """(src, dst): m distinct pairs without an edge, nor in ``excluded``; ends drawn evenly, or by degree if ``biased``. Too few such pairs are an error."""
    taken = g.edges.select("src", "dst").where("src != dst").distinct()
    if excluded is not None:
        taken = taken.unionByName(excluded.select("src", "dst") if g.directed else excluded.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))).distinct()
    taken = store(taken)
    n = g.vertices.count()
    pairs = n * (n - 1) // (1 if g.directed else 2)
    if m > pairs - taken.count():
        raise ValueError("fewer pairs are without an edge")
    pool = g.both.select("v") if biased else g.vertices.select("v")
    numbers = store(pool.withColumn("i", F.row_number().over(Window.orderBy(F.xxhash64("v"), "v")) - 1))  # the pool in one task
    size, found, turn = numbers.count(), None, 0
    while True:
        have = 0 if found is None else found.count()
        if have >= m:
            ranked = found.withColumn("o", F.xxhash64("src", "dst", F.lit(seed)))
            return ranked.orderBy("o", "src", "dst").limit(m).select("src", "dst")
        d = g.spark.range(3 * (m - have) + 16).select(*[F.floor(uniform(F.col("id"), turn, k, seed) * size).cast("long").alias(c) for k, c in enumerate("ab")])
        d = d.join(numbers.select(F.col("i").alias("a"), F.col("v").alias("x")), "a").join(numbers.select(F.col("i").alias("b"), F.col("v").alias("y")), "b").where("x != y")
        d = d.select("x", "y").toDF("src", "dst") if g.directed else d.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
        d = d.distinct().join(taken, ["src", "dst"], "left_anti")
        found = store(d if found is None else found.unionByName(d).distinct())
        turn += 1


def split_edges(g: Graph, share: float, seed: int = 0, connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, test): the edges held out with a share, by hash; ``connected`` never holds out a spanning forest's edges, so components stay as they are."""
    held = uniform(F.col("eid"), "held", seed) < share
    test = g.edges.where(held)
    if connected:
        from lattica.operators.iterate import minimum_spanning_forest

        weighed = Graph(g.vertices, g.edges.withColumn("draw", uniform(F.col("eid"), "forest", seed)), g.directed)
        test = test.join(minimum_spanning_forest(weighed, "draw"), "eid", "left_anti")
    test = store(test)
    return g.edges.join(test.select("eid"), "eid", "left_anti"), test
