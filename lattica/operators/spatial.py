"""Graphs of points: nearest neighbours, and neighbours whose region between them is empty. Points are (v, x), x an array of coordinates.

Region graphs look at all pairs and, for each, for a point inside: pairs are n squared by the definition.
Each pair is kept or ruled out by an anti-join, so no pair meets all points unless it is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.shipping import ship


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Euclidean or Manhattan distance of two arrays."""
    if metric == "manhattan":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric != "euclidean":
        raise ValueError("metric: euclidean or manhattan")
    return F.sqrt(_squared(a, b))


def spatial_edge_lengths(g: Graph, points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(eid, length)."""
    e = g.edges.select("eid", "src", "dst").join(points.select(F.col("v").alias("src"), F.col("x").alias("a")), "src").join(points.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst")
    return e.select("eid", distance(F.col("a"), F.col("b"), metric).alias("length"))


def nearest_neighbors(points: DataFrame, k: int, cutoff: float | None = None, metric: str = "euclidean") -> DataFrame:
    """(v, u, rank, length): the k nearest other points within ``cutoff``, ties by id."""
    y = points.select(F.col("v").alias("u"), F.col("x").alias("y"))
    pairs = points.join(y, F.col("v") != F.col("u")).select("v", "u", distance(F.col("x"), F.col("y"), metric).alias("length"))
    if cutoff is not None:
        pairs = pairs.where(F.col("length") <= cutoff)
    order = Window.partitionBy("v").orderBy("length", "u")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("v", "u", "rank", "length")


def nearest_neighbor_graph(points: DataFrame, k: int, cutoff: float | None = None, metric: str = "euclidean", directed: bool = False) -> Graph:
    """Each point to its k nearest; undirected, each such pair once."""
    e = nearest_neighbors(points, k, cutoff, metric).select(F.col("v").alias("src"), F.col("u").alias("dst"))
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return Graph.from_edges(e, directed, points.select("v"))


def _empty_regions(points: DataFrame, inside: Column) -> Graph:
    """Pairs p, q for which no third point r is ``inside``, an expression over the squared lengths pq, pr, qr and the arrays p, q, r."""
    p, q = points.select(F.col("v").alias("src"), F.col("x").alias("p")), points.select(F.col("v").alias("dst"), F.col("x").alias("q"))
    pairs = p.join(q, F.col("src") < F.col("dst")).withColumn("pq", _squared(F.col("p"), F.col("q")))
    r = points.select(F.col("v").alias("w"), F.col("x").alias("r"))
    kept = pairs.join(r, (F.col("w") != F.col("src")) & (F.col("w") != F.col("dst")) & inside, "left_anti")
    return Graph.from_edges(kept.select("src", "dst"), False, points.select("v"))


def gabriel_graph(points: DataFrame) -> Graph:
    """Pairs whose circle, with the pair as diameter, holds no other point inside."""
    return _empty_regions(points, _squared(F.col("p"), F.col("r")) + _squared(F.col("q"), F.col("r")) < F.col("pq") * (1 - 1e-12))


def relative_neighborhood_graph(points: DataFrame) -> Graph:
    """Pairs to which no third point is nearer than they are to each other."""
    return _empty_regions(points, F.greatest(_squared(F.col("p"), F.col("r")), _squared(F.col("q"), F.col("r"))) < F.col("pq") * (1 - 1e-12))


def lune_beta_skeleton(points: DataFrame, beta: float) -> Graph:
    """Pairs whose lune for ``beta`` of 1 or more is empty: two balls of radius beta/2 times the distance, centred on the line through the pair."""
    if beta < 1:
        raise ValueError("beta must be 1 or more")
    centre = lambda a, b: F.zip_with(a, b, lambda x, y: x * (1 - beta / 2) + y * (beta / 2))
    radius = F.col("pq") * (beta / 2) ** 2 * (1 - 1e-12)
    one, two = centre(F.col("p"), F.col("q")), centre(F.col("q"), F.col("p"))
    return _empty_regions(points, (_squared(one, F.col("r")) < radius) & (_squared(two, F.col("r")) < radius))


def circle_beta_skeleton(points: DataFrame, beta: float) -> Graph:
    """Pairs in the plane seen by no third point under more than the angle of ``beta``: for beta of 1 or more the union of two circles is empty, below it their intersection."""
    if beta <= 0:
        raise ValueError("beta must be positive")
    # a point on the circles sees the pair under an angle of asin(1 / beta), or pi less asin(beta)
    least = math.asin(1 / beta) if beta >= 1 else math.pi - math.asin(beta)
    a, b = _squared(F.col("p"), F.col("r")), _squared(F.col("q"), F.col("r"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a + b - F.col("pq")) / (2 * F.sqrt(a * b)))))
    return _empty_regions(points, (a > 0) & (b > 0) & (angle > least + 1e-12))


def beta_weighted_gabriel_graph(points: DataFrame) -> DataFrame:
    """(src, dst, beta): the Gabriel edges with the largest beta whose lune is still empty, null if it always is.

    A point r is in the lune of beta as soon as beta is over the greater of what the two balls ask:
    with t = (r - p).(q - p) / |pq|^2, |pr|^2 < beta (t |pq|^2) and the same seen from q.
    """
    g = gabriel_graph(points).edges.select("src", "dst")
    e = g.join(points.select(F.col("v").alias("src"), F.col("x").alias("p")), "src").join(points.select(F.col("v").alias("dst"), F.col("x").alias("q")), "dst").withColumn("pq", _squared(F.col("p"), F.col("q")))
    e = e.join(points.select(F.col("v").alias("w"), F.col("x").alias("r")), (F.col("w") != F.col("src")) & (F.col("w") != F.col("dst")), "left")
    pr, qr = _squared(F.col("p"), F.col("r")), _squared(F.col("q"), F.col("r"))
    along = (pr + F.col("pq") - qr) / 2  # (r - p).(q - p)
    back = F.col("pq") - along
    needed = F.when((along > 0) & (back > 0), F.greatest(pr / along, qr / back))
    return e.groupBy("src", "dst").agg(F.min(needed).alias("beta"))


def _hull(rows: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
    rows = sorted(rows)
    if len(rows) < 3:
        return rows
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    parts = []
    for way in (rows, rows[::-1]):
        chain: list[tuple[float, float, int]] = []
        for r in way:
            while len(chain) > 1 and cross(chain[-2], chain[-1], r) <= 0:
                chain.pop()
            chain.append(r)
        parts += chain[:-1]
    return parts


def convex_hull_2d(points: DataFrame) -> DataFrame:
    """(i, v, x, y): the hull's corners counter-clockwise, from the leftmost. Each partition gives its own hull, and the hull of those is made at the end."""
    ship(points.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[float, float, int]] = []
        for batch in batches:
            held = _hull(held + list(zip(batch.px, batch.py, batch.v)))
        yield pd.DataFrame(held, columns=["px", "py", "v"])

    flat = points.select("v", F.col("x")[0].alias("px"), F.col("x")[1].alias("py"))
    corners = flat.mapInPandas(run, "px double, py double, v long").coalesce(1).mapInPandas(run, "px double, py double, v long")
    return corners.select(F.monotonically_increasing_id().alias("i"), "v", F.col("px").alias("x"), F.col("py").alias("y"))
