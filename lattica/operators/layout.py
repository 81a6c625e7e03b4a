"""Places for vertices: closed forms as columns, and sequential methods a component at a time. Coordinates are columns x, y (and z)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.kernels import per_component
from lattica.plans.random_graphs import uniform


def numbered(vertices: DataFrame) -> DataFrame:
    """(v, i): the vertices from 0 on in the order of their ids. Counts by ranges of ids make it a join, not one sorted task."""
    parts = vertices.select("v").repartitionByRange("v").withColumn("part", F.spark_partition_id())
    parts = store(parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("v"))))
    sizes = parts.groupBy("part").agg(F.max("k").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each partition
    return parts.join(F.broadcast(before), "part").select("v", (F.col("before") + F.col("k") - 1).cast("long").alias("i"))  # a row for each partition


def layout_random(g: Graph, seed: int = 0, dims: int = 2) -> DataFrame:
    """Uniform in the square or cube from -1 to 1, drawn from the seed and the id."""
    return g.vertices.select("v", *[(2 * uniform(F.col("v"), k, seed) - 1).alias("xyz"[k]) for k in range(dims)])


def layout_circle(g: Graph, order: DataFrame | None = None) -> DataFrame:
    """On the unit circle by id, or by ``order`` (v, i); others at the origin."""
    order = store(numbered(g.vertices) if order is None else order)
    n = max(1, order.count())
    at = F.col("i") * (2 * math.pi / n)
    return g.vertices.select("v").join(order, "v", "left").select("v", F.coalesce(F.cos(at), F.lit(0.0)).alias("x"), F.coalesce(F.sin(at), F.lit(0.0)).alias("y"))


def layout_star(g: Graph, center: int) -> DataFrame:
    """The centre at the origin, the others on the unit circle by id."""
    rest = Graph(g.vertices.where(F.col("v") != center), g.edges)
    return layout_circle(rest).unionByName(g.vertices.where(F.col("v") == center).select("v", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def layout_grid(g: Graph, width: int = 0) -> DataFrame:
    """Row by row; ``width`` 0: the square root of n, rounded up."""
    at = store(numbered(g.vertices))
    width = width if width > 0 else max(1, math.isqrt(max(0, at.count() - 1)) + 1)
    return at.select("v", (F.col("i") % width).cast("double").alias("x"), F.expr(f"i div {width}").cast("double").alias("y"))


def layout_grid_3d(g: Graph, width: int = 0, height: int = 0) -> DataFrame:
    """Layer by layer; ``width`` and ``height`` 0: the cube root of n, rounded up, or the square root of what one of them leaves."""
    at = store(numbered(g.vertices))
    n = at.count()
    if width <= 0 and height <= 0:
        width = height = max(1, math.ceil(round(n ** (1 / 3), 9)))
    elif width <= 0:
        width = max(1, math.ceil(round(math.sqrt(n / height), 9)))
    elif height <= 0:
        height = max(1, math.ceil(round(math.sqrt(n / width), 9)))
    return at.select("v", (F.col("i") % width).cast("double").alias("x"), F.expr(f"(i div {width}) % {height}").cast("double").alias("y"), F.expr(f"i div {width * height}").cast("double").alias("z"))


def layout_sphere(g: Graph) -> DataFrame:
    """A spiral over the unit sphere (Saff and Kuijlaars): heights in equal steps, each turn as far from the last as its circle is wide."""
    at = store(numbered(g.vertices))
    n = at.count()
    z = F.when(F.col("i") == 0, F.lit(-1.0)).when(F.col("i") == n - 1, F.lit(1.0)).otherwise(-1.0 + 2.0 * F.col("i") / max(1, n - 1))
    t = at.select("v", "i", z.alias("z")).withColumn("r", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("z") * F.col("z"))))
    turn = F.when((F.col("i") > 0) & (F.col("i") < n - 1), F.lit(3.6) / F.sqrt(F.lit(float(n))) / F.col("r")).otherwise(0.0)
    parts = t.withColumn("turn", turn).withColumn("part", F.expr("i div 4096"))
    sums = parts.groupBy("part").agg(F.sum("turn").alias("s")).select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))  # a row for 4,096 vertices
    angle = F.col("before") + F.sum("turn").over(Window.partitionBy("part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    ended = F.when((F.col("i") == 0) | (F.col("i") == n - 1), 0.0).otherwise(angle)
    return parts.join(sums, "part").withColumn("angle", ended).select("v", (F.col("r") * F.cos("angle")).alias("x"), (F.col("r") * F.sin("angle")).alias("y"), "z")


def _steps(vertices: list[int], edges: list[tuple[int, int, int]]) -> np.ndarray:
    """All distances in steps, by one breadth-first frontier of all sources at a time."""
    at = {v: i for i, v in enumerate(vertices)}
    near = np.zeros((len(vertices), len(vertices)), bool)
    for _, a, b in edges:
        near[at[a], at[b]] = near[at[b], at[a]] = True
    dist = np.where(np.eye(len(vertices), dtype=bool), 0, -1)
    front, k = np.eye(len(vertices), dtype=bool), 0
    while front.any():
        k += 1
        front = (front.astype(np.float32) @ near > 0) & (dist < 0)
        dist[front] = k
    return dist


def _placed(vertices: list[int], places: np.ndarray):
    return ((v, *map(float, p)) for v, p in zip(vertices, places))


def _ddl(dims: int) -> str:
    return "v long, " + ", ".join(f"{c} double" for c in "xyz"[:dims])


def layout_mds(g: Graph, dims: int = 2, most_edges: int = 20_000) -> DataFrame:
    """Classical scaling of the distances of each component: the leading axes of the doubly centred squares."""

    def kernel(vertices, edges):
        n = len(vertices)
        centre = np.eye(n) - 1.0 / n
        values, vectors = np.linalg.eigh(-0.5 * centre @ (_steps(vertices, edges).astype(float) ** 2) @ centre)
        top = np.argsort(-values)[:dims]
        places = np.zeros((n, dims))
        places[:, : len(top)] = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        yield from _placed(vertices, places)

    return per_component(g, kernel, _ddl(dims), most_edges)


def layout_fruchterman_reingold(g: Graph, dims: int = 2, rounds: int = 500, seed: int = 0, most_edges: int = 50_000) -> DataFrame:
    """Edges pull by the square of their length, vertices push by its inverse, steps shrink with the temperature; a component at a time, from drawn places."""

    def kernel(vertices, edges):
        n = len(vertices)
        at = {v: i for i, v in enumerate(vertices)}
        ends = np.array([(at[a], at[b]) for _, a, b in edges if a != b], int).reshape(-1, 2)
        p = np.random.Generator(np.random.PCG64([seed, vertices[0] & 0xFFFFFFFF])).uniform(-1, 1, (n, dims)) * math.sqrt(n)
        for t in np.linspace(math.sqrt(n), 0, rounds, endpoint=False):
            gap = p[:, None] - p[None]
            length = np.maximum((gap**2).sum(2), 1e-9)
            move = (gap / length[..., None]).sum(1)
            pull = p[ends[:, 0]] - p[ends[:, 1]]
            pull = pull * np.sqrt((pull**2).sum(1, keepdims=True))
            np.subtract.at(move, ends[:, 0], pull)
            np.add.at(move, ends[:, 1], pull)
            size = np.sqrt((move**2).sum(1, keepdims=True))
            p = p + move * np.minimum(1, t / np.maximum(size, 1e-12))
        yield from _placed(vertices, p)

    return per_component(g, kernel, _ddl(dims), most_edges)


def layout_kamada_kawai(g: Graph, dims: int = 2, rounds: int = 300, most_edges: int = 20_000) -> DataFrame:
    """Springs as long as the distances, of strength one over their square: stress majorization from a circle (or a spiral in space)."""

    def kernel(vertices, edges):
        n = len(vertices)
        if n == 1:
            yield (vertices[0], *[0.0] * dims)
            return
        want = _steps(vertices, edges).astype(float)
        w = np.where(want > 0, 1 / np.maximum(want, 1) ** 2, 0.0)
        inverse = np.linalg.pinv(np.diag(w.sum(1)) - w)
        turn = 2 * math.pi * np.arange(n) / n
        p = np.stack([np.cos(turn), np.sin(turn), np.linspace(-1, 1, n)][:dims], 1)
        for _ in range(rounds):
            gap = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
            b = -w * np.divide(want, gap, out=np.zeros_like(gap), where=gap > 1e-12)
            np.fill_diagonal(b, 0)
            np.fill_diagonal(b, -b.sum(1))
            new = inverse @ b @ p
            if np.abs(new - p).max() < 1e-7:
                p = new
                break
            p = new
        yield from _placed(vertices, p)

    return per_component(g, kernel, _ddl(dims), most_edges)


def layout_align(layout: DataFrame) -> DataFrame:
    """A plane layout with its centre at the origin and its longest axis along x."""
    one = layout.agg(*[F.expr(x).alias(n) for n, x in {"mx": "avg(x)", "my": "avg(y)", "xx": "var_pop(x)", "yy": "var_pop(y)", "xy": "covar_pop(x, y)"}.items()])
    at = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    t = layout.crossJoin(F.broadcast(one)).withColumn("t", at)  # one row
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return t.select("v", (x * F.cos("t") + y * F.sin("t")).alias("x"), (y * F.cos("t") - x * F.sin("t")).alias("y"))
