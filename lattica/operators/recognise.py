"""Yes-or-no questions, each one aggregation or one fixed point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph, store
from lattica.operators.distances import distances
from lattica.operators.iterate import connected_components


def facts(g: Graph) -> DataFrame:
    """(name, value): what the edge list, its degrees and its components say."""
    flags = g.edges.agg(F.count("*").alias("m"), F.coalesce(F.count_if(F.col("src") == F.col("dst")), F.lit(0)).alias("loops"), F.count_distinct("src", "dst").alias("pairs"))
    d = g.degrees().agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.count_if(F.col("d") % 2 == 1).alias("odd"), F.count_if(F.col("d") > 0).alias("touched"))
    c = connected_components(g).join(g.degrees(), "v").groupBy("component").agg(F.max("d").alias("d")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("with_edges"))
    one = lambda x: x.withColumn("one", F.lit(1))
    t = one(flags).join(one(d), "one").join(one(c), "one")
    made = {
        "is_connected": "c = 1", "is_simple": "loops = 0 and pairs = m", "has_loop": "loops > 0", "has_multiple": "pairs < m", "is_tree": "c = 1 and m = n - 1", "is_forest": "m = n - c", "is_regular": "low = high",
        "is_complete": "loops = 0 and pairs = n * (n - 1) div 2", "is_eulerian_path": "with_edges <= 1 and odd <= 2", "is_eulerian_cycle": "with_edges <= 1 and odd = 0", "is_empty_graph": "m = 0", "is_path": "c = 1 and m = n - 1 and high <= 2",
        "is_cycle": "c = 1 and low = 2 and high = 2 and n > 2 and loops = 0 and pairs = m", "is_star": "c = 1 and m = n - 1 and high = n - 1", "is_unicyclic": "c = 1 and m = n", "is_cubic": "low = 3 and high = 3", "is_subcubic": "high <= 3", "is_cactus_size": "m <= 3 * (n - 1) div 2",
    }
    return t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(x).cast("boolean").alias("value")) for n, x in made.items()])).alias("p")).select("p.*")


def bipartite_sides(g: Graph) -> DataFrame:
    """(v, side): the parity of the distance from the least vertex of the component."""
    roots = connected_components(g).select(F.col("component").alias("v")).distinct()
    return distances(g, roots).select(F.col("t").alias("v"), (F.col("dist") % 2).cast("long").alias("side"))


def frustrated_edges(g: Graph, sides: DataFrame | None = None) -> DataFrame:
    """The edges within a side: none if the graph is bipartite."""
    sides = store(bipartite_sides(g)) if sides is None else sides
    e = g.edges.join(sides.select(F.col("v").alias("src"), F.col("side").alias("x")), "src").join(sides.select(F.col("v").alias("dst"), F.col("side").alias("y")), "dst")
    return e.where("x = y").select("eid", "src", "dst")


def is_bipartite(g: Graph) -> bool:
    return frustrated_edges(g).isEmpty()


def is_triangle_free(g: Graph) -> bool:
    from lattica.operators.triangles import list_triangles

    return list_triangles(g).isEmpty()
