"""Small patterns counted, against those listed."""

import random

from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import patterns


def test_small_patterns_as_listed(spark):
    rng = random.Random(2)
    g = Graph.from_lists(spark, 12, [(rng.randrange(11), rng.randrange(11)) for _ in range(50)])
    names = list(patterns.SMALL)
    assert {r.name: r.copies for r in patterns.pattern_counts(g, names).collect()} == {x: patterns.embeddings(g, patterns.PATTERNS[x]).count() for x in names}


def test_small_patterns_of_a_large_star(spark):
    n = 20_000
    g = Graph.from_edges(spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    want = {"p3": n * (n - 1) // 2, "claw": n * (n - 1) * (n - 2) // 6}
    assert {r.name: r.copies for r in patterns.pattern_counts(g, list(patterns.SMALL)).collect()} == {x: want.get(x, 0) for x in patterns.SMALL}
