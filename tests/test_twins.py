"""Twins merged: the same answers as brute force over every vertex, and graphs too large without."""

import math
import random

import numpy as np
import pytest

from lattica.graph import Graph
from lattica.operators import distances, iterate, kernels


def leafy(spark, seed=1):
    """A small graph of two components with twins of several kinds, a loop, parallel edges and an isolated vertex: its pairs, and the graph."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(6), rng.randrange(6)) for _ in range(8)] + [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (2, 2)]
    pairs += [(rng.randrange(6), 6 + i) for i in range(8)] + [(0, 14), (1, 14), (0, 15), (1, 15), (3, 16), (3, 16), (3, 17), (3, 17)]
    pairs += [(20, 21), (20, 22), (20, 23)]
    return pairs, Graph.from_lists(spark, 25, pairs)


def spider(spark, leaves=25_000):
    """A path 0 - 1 - 2 whose ends have many leaves, a third more at one."""
    return Graph.from_edges(spark.range(3, leaves).selectExpr("id as src", "if(id % 7 < 4, 0L, 2L) as dst").union(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")))


def matrices(pairs, n, vertices):
    a = np.zeros((n, n))
    for x, y in pairs:
        if x != y:
            a[x, y] += 1
            a[y, x] += 1
    a = a[np.ix_(vertices, vertices)]
    return a, np.diag(a.sum(0)) - a


@pytest.mark.parametrize("seed", [1, 2])
def test_spectra_of_a_graph_with_twins(spark, seed):
    pairs, g = leafy(spark, seed)
    got = {}
    for r in kernels.spectra(g).collect():
        got.setdefault(r.component, []).append((r.i, r.adjacency, r.laplacian))
    for component, vertices in {0: list(range(18)), 20: [20, 21, 22, 23], 24: [24]}.items():
        a, lap = matrices(pairs, 25, vertices)
        rows = sorted(got[component])
        assert np.allclose([r[1] for r in rows], np.linalg.eigvalsh(a)) and np.allclose([r[2] for r in rows], np.linalg.eigvalsh(lap))


def test_laplacian_energy_is_given(spark):
    pairs, g = leafy(spark)
    got = {(r.component, r.name): r.value for r in kernels.spectral_measures(g).collect()}
    values = np.linalg.eigvalsh(matrices(pairs, 25, list(range(18)))[1])
    assert math.isclose(got[0, "laplacian_energy"], np.abs(values - values.mean()).sum())
    assert len(got) == 5 * 8


def test_spectra_of_a_large_tree(spark):
    got = {r.name: r.value for r in kernels.spectral_measures(spider(spark)).collect()}
    assert math.isclose(got["spanning_tree_count"], 1.0, rel_tol=1e-6)


def searched(pairs, n):
    """{(s, t): (dist, paths)} by breadth first search from each vertex."""
    near = [[y if x == v else x for x, y in pairs if v in (x, y) and x != y] for v in range(n)]
    out = {}
    for s in range(n):
        dist, ways, queue = {s: 0}, {s: 1}, [s]
        for v in queue:
            for u in near[v]:
                if u not in dist:
                    dist[u], ways[u] = dist[v] + 1, 0
                    queue.append(u)
                if dist[u] == dist[v] + 1:
                    ways[u] += ways[v]
        out |= {(s, t): (dist[t], ways[t]) for t in queue}
    return out


def connected(spark, seed):
    """The first component of leafy()."""
    pairs = [e for e in leafy(spark, seed)[0] if e[0] < 20]
    return pairs, Graph.from_lists(spark, 18, pairs)


def near_enough(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9) for k in a)


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_of_a_graph_with_twins(spark, seed):
    pairs, g = leafy(spark, seed)
    found = searched(pairs, 25)
    rows = distances.distances(g).collect()
    assert len(rows) == len(found) and {(r.s, r.t): (r.dist, r.paths) for r in rows} == found
    near = {(r.s, r.t): (r.dist, r.paths) for r in distances.distances(g, limit=1).collect()}
    assert near == {k: x for k, x in found.items() if x[0] <= 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_of_a_graph_with_twins(spark, seed):
    pairs, g = leafy(spark, seed)
    found, want = searched(pairs, 25), {v: 0.0 for v in range(25)}
    for (s, t), (d, k) in found.items():
        for v in range(25):
            if v not in (s, t) and (s, v) in found and (v, t) in found and found[s, v][0] + found[v, t][0] == d:
                want[v] += found[s, v][1] * found[v, t][1] / k / 2
    assert near_enough({r.v: r.betweenness for r in distances.betweenness(g).collect()}, want)


def named(df):
    return {r.name: r.value for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_distance_indices_of_a_graph_with_twins(spark, seed):
    pairs, g = connected(spark, seed)
    every = spark.createDataFrame([(s, t, d, k) for (s, t), (d, k) in searched(pairs, 18).items()], "s long, t long, dist int, paths long")
    assert near_enough(named(distances.distance_indices(g)), named(distances.distance_indices(g, every)))


@pytest.mark.parametrize("seed", [1, 2])
def test_szeged_indices_of_a_graph_with_twins(spark, seed):
    pairs, g = connected(spark, seed)
    every = spark.createDataFrame([(s, t, d, k) for (s, t), (d, k) in searched(pairs, 18).items()], "s long, t long, dist int, paths long")
    assert near_enough(named(distances.szeged_indices(g)), named(distances.szeged_indices(g, every)))


@pytest.mark.parametrize("seed", [1, 2])
def test_path_lengths_of_a_graph_with_twins(spark, seed):
    pairs, g = leafy(spark, seed)
    want = {}
    for (s, t), (d, _) in searched(pairs, 25).items():
        if s < t:
            want[d] = want.get(d, 0) + 1
    assert {r.length: r.pairs for r in distances.path_length_hist(distances.class_distances(g)[0], False).collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_vertex_distances_of_a_graph_with_twins(spark, seed):
    pairs, g = leafy(spark, seed)
    every = spark.createDataFrame([(s, t, d, k) for (s, t), (d, k) in searched(pairs, 25).items()], "s long, t long, dist int, paths long")
    key = lambda rows: sorted((r.v, r.eccentricity, r.reachable, r.farness, round(r.harmonic_sum, 9), r.closeness) for r in rows)
    assert str(key(distances.vertex_distances(*distances.class_distances(g)[:2]).collect())) == str(key(distances.vertex_distances(every).collect()))


def test_path_lengths_of_a_large_tree(spark):
    g = spider(spark)
    got = {r.length: r.pairs for r in distances.path_length_hist(distances.class_distances(g)[0], False).collect()}
    a = g.edges.where("least(src, dst) = 0 and greatest(src, dst) > 2").count()
    b = 24_997 - a
    assert got == {1: 24_999, 2: a * (a - 1) // 2 + b * (b - 1) // 2 + a + b + 1, 3: a + b, 4: a * b}


def test_girth_of_large_trees_and_cycles(spark):
    g = spider(spark)
    assert [(r.component, r.girth) for r in kernels.girth(g).collect()] == [(0, None)]
    ring = spark.range(9_000).selectExpr("id + 30000 as src", "(id + 1) % 9000 + 30000 as dst")
    more = g.edges.select("src", "dst").union(ring).union(spark.createDataFrame([(40_000, 40_001), (40_001, 40_002), (40_002, 40_003), (40_003, 40_000), (40_000, 30_000)], "src long, dst long"))
    assert {(r.component, r.girth) for r in kernels.girth(Graph.from_edges(more)).collect()} == {(0, None), (30_000, 4)}


def test_fiedler_of_a_graph_with_twins(spark):
    pairs, g = leafy(spark)
    got = {r.v: (r.value, r.side) for r in kernels.fiedler(g).collect()}
    assert got.keys() == set(range(25)) and all(side == (x < 0) for x, side in got.values())
    for vertices in (list(range(18)), [20, 21, 22, 23]):  # the second is a star, whose vector is of its leaves
        lap = matrices(pairs, 25, vertices)[1]
        x = np.array([got[v][0] for v in vertices])
        assert np.allclose(lap @ x, np.linalg.eigvalsh(lap)[1] * x) and math.isclose(x @ x, 1) and abs(x.sum()) < 1e-9
    assert kernels.fiedler(spider(spark)).where("side = 1").count() > 8_000


def test_katz_of_a_graph_with_twins(spark, monkeypatch):
    pairs, g = leafy(spark)
    plain = [e for e in pairs if e[0] != e[1]]
    for e, graph in ((plain, Graph.from_lists(spark, 25, plain)), (pairs, g)):
        a = matrices(e, 25, list(range(25)))[0] + np.diag([2.0 * sum(x == y == v for x, y in e) for v in range(25)])
        got = {r.v: r.x for r in iterate.katz_centrality(graph, 0.05, tolerance=1e-10).collect()}
        assert np.allclose([got[v] for v in range(25)], np.linalg.solve(np.eye(25) - 0.05 * a, np.ones(25)))
    monkeypatch.setattr(iterate, "STEPS", 0)
    got = {r.v: r.x for r in iterate.katz_centrality(Graph.from_lists(spark, 3, [(0, 1), (0, 2)]), 0.05).collect()}
    assert math.isclose(got[0], 1.1 / 0.995, rel_tol=1e-6)
    monkeypatch.undo()
    with pytest.raises(ArithmeticError):
        iterate.katz_centrality(spider(spark), 0.02)
