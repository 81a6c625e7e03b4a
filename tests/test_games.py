"""Random graphs of dense rows: what must hold of their counts, and reruns."""

from pyspark.sql import functions as F

from lattica.plans import random_models


def facts(g):
    r = g.edges.agg(F.count("*").alias("m"), F.count_if(F.col("src") >= F.col("dst")).alias("odd"), F.count_distinct("src", "dst", "eid").alias("kinds"), F.sum(F.xxhash64("src", "dst") % 1000).alias("sum")).first()
    assert r.odd == 0 and r.kinds == r.m
    return r.m, r.sum


def test_sbm_game_of_long_rows(spark):
    got = facts(random_models.sbm_game(spark, [4000, 20], [[0.1, 0.01], [0.01, 0.3]], 5))
    mean, var = 4000 * 3999 / 2 * 0.1 + 80_000 * 0.01 + 190 * 0.3, 4000 * 3999 / 2 * 0.09 + 1000
    assert abs(got[0] - mean) < 6 * var**0.5 and got == facts(random_models.sbm_game(spark, [4000, 20], [[0.1, 0.01], [0.01, 0.3]], 5))


def test_preference_game_of_long_rows(spark):
    def play():
        g, types = random_models.preference_game(spark, 3000, [0.3, 0.7], [[0.2, 0.05], [0.05, 0.1]], 5)
        return g, {r.type: r["count"] for r in types.groupBy("type").count().collect()}

    g, k = play()
    m = facts(g)
    mean = k[0] * (k[0] - 1) / 2 * 0.2 + k[0] * k[1] * 0.05 + k[1] * (k[1] - 1) / 2 * 0.1
    assert k[0] + k[1] == 3000 and abs(m[0] - mean) < 6 * mean**0.5 and m == facts(play()[0])


def test_correlated_game_of_long_rows(spark):
    first, second = random_models.correlated_pair_game(spark, 3000, 0.8, 0.1, 5)
    pairs = 3000 * 2999 / 2
    a, b = facts(first)[0], facts(second)
    both = first.edges.join(second.edges, ["src", "dst"]).count()
    assert abs(a - pairs * 0.1) < 6 * (pairs * 0.09) ** 0.5 and abs(b[0] - pairs * 0.1) < 6 * (pairs * 0.09) ** 0.5
    assert abs(both - a * 0.82) < 6 * (a * 0.15) ** 0.5 and b == facts(random_models.correlated_pair_game(spark, 3000, 0.8, 0.1, 5)[1])
