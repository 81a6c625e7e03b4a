"""Twins: vertices of the same neighbours, with as many edges to each, and not next to each other.

They have the same distances, degrees and spectra, so a measure of all pairs needs one of each class. Merging them
is exact; a graph without twins stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store

#: Vertices with more neighbours are a class of their own, so that no long list is sorted.
MOST_NEIGHBOURS = 64


def twin_classes(g: Graph) -> DataFrame:
    """(v, c): the least twin of each vertex, by edges whatever their direction; isolated vertices and those with loops are alone."""
    near = store(g.both.groupBy("v", "u").agg(F.count("*").alias("k")))
    short = near.groupBy("v").agg(F.count("*").alias("n"), F.max(F.col("v") == F.col("u")).alias("loop")).where(f"n <= {MOST_NEIGHBOURS} and not loop")
    lists = near.join(short.select("v"), "v").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("u", "k"))).alias("near"))
    least = lists.join(lists.groupBy("near").agg(F.min("v").alias("c")), "near").select("v", "c")
    return store(g.vertices.select("v").join(least, "v", "left").select("v", F.coalesce("c", "v").alias("c")))


def merged(g: Graph) -> tuple[Graph, DataFrame]:
    """A graph of one vertex a class, (v, size), and simple edges (eid, src, dst, k), loops left out, k being the copies between two members; and the classes (v, c)."""
    classes = twin_classes(g)
    sizes = store(classes.groupBy(F.col("c").alias("v")).agg(F.count("*").alias("size")))
    edges = g.edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    edges = edges.join(sizes.select(F.col("v").alias("src")), "src", "left_semi").join(sizes.select(F.col("v").alias("dst")), "dst", "left_semi").groupBy("src", "dst").agg(F.count("*").alias("k"))
    return Graph.from_edges(edges, False, sizes), classes
