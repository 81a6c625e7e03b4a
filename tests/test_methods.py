"""Operators without SQL, against brute force or on graphs with known answers."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators import classes, communities, distances, flows, iterate, layout, paths, patterns, spectral
from lattica.plans import random_models


def ring_of_cliques(spark, k=4, size=5):
    """k cliques, each linked to the next by one edge."""
    pairs = [(c * size + a, c * size + b) for c in range(k) for a, b in combinations(range(size), 2)]
    return Graph.from_lists(spark, k * size, pairs + [(c * size, (c + 1) % k * size + 1) for c in range(k)])


@pytest.mark.parametrize("method", [communities.louvain, communities.leiden, communities.fast_greedy, communities.walktrap, communities.leading_eigenvector, communities.edge_betweenness_communities])
def test_communities_find_cliques(spark, method):
    found = {r.v: r.community for r in method(ring_of_cliques(spark)).collect()}
    assert found == {v: v // 5 * 5 for v in range(20)}


def test_fluid_communities_cover_all(spark):
    found = {r.v: r.community for r in communities.fluid_communities(ring_of_cliques(spark), 4, 1).collect()}
    assert len(found) == 20 and -1 not in found.values() and 1 <= len(set(found.values())) <= 4


def test_louvain_raises_modularity(spark):
    g = ring_of_cliques(spark, 5, 4)
    q = lambda labels: communities.modularity(g, labels).first()[0]
    best = q(communities.louvain(g).withColumnRenamed("community", "label"))
    assert best > q(g.vertices.select("v", F.col("v").alias("label"))) and best >= q(g.vertices.selectExpr("v", "v div 4 as label")) - 1e-9
    empty = Graph.from_lists(spark, 3, [])
    assert {(r.v, r.community) for r in communities.louvain(empty).collect()} == {(0, 0), (1, 1), (2, 2)}


def simple_paths(near, at, goal, path):
    if at == goal:
        yield path
        return
    for u, w in near[at]:
        if u not in [x for x, _ in path]:
            yield from simple_paths(near, u, goal, [*path, (u, w)])


def test_k_shortest_paths(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    pairs = [(a, b) for a, b in combinations(range(9), 2) if rng.random() < 0.45]
    weights = [float(x) for x in rng.integers(1, 9, len(pairs))]
    g = Graph.from_lists(spark, 9, pairs, False, weights)
    near = {v: [(b if a == v else a, w) for (a, b), w in zip(pairs, weights) if v in (a, b)] for v in range(9)}
    every = sorted((sum(w for _, w in p), [x for x, _ in p]) for p in simple_paths(near, 0, 8, [(0, 0.0)]))
    got = [(r.length, r.path) for r in paths.k_shortest_paths(g, 0, 8, 6, "weight").orderBy("rank").collect()]
    assert got == every[:6]
    assert paths.k_shortest_paths(Graph.from_lists(spark, 3, [(0, 1)]), 0, 2, 3).isEmpty()


def test_fundamental_cycles_are_as_many_as_the_circuit_rank(spark):
    g = ring_of_cliques(spark, 3, 4)
    found = paths.fundamental_cycles(g).collect()
    assert len(found) == 21 - 12 + 1 and all(3 <= r.length for r in found)
    assert [r.length for r in paths.fundamental_cycles(Graph.from_lists(spark, 5, [(i, (i + 1) % 5) for i in range(5)])).collect()] == [5]


def test_modes(spark):
    g = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (3, 2)], True)
    reach = lambda mode: {(r.s, r.t) for r in distances.distances(g.as_mode(mode)).where("s != t").collect()}
    assert reach("out") == {(0, 1), (0, 2), (1, 2), (3, 2)} and reach("in") == {(b, a) for a, b in reach("out")} and len(reach("all")) == 12


def test_flows(spark):
    g = ring_of_cliques(spark, 3, 4)
    assert (flows.vertex_connectivity(g), flows.edge_connectivity(g)) == (2, 2)
    value, side, cut = flows.mincut(g)
    assert value == 2 and cut.count() == 2 and 0 < side.count() < 12
    full = Graph.from_lists(spark, 5, list(combinations(range(5), 2)))
    assert (flows.vertex_connectivity(full), flows.edge_connectivity(full)) == (4, 4)
    tree = flows.gomory_hu_tree(full).collect()
    assert len(tree) == 4 and all(r.flow == 4 for r in tree)
    path = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (2, 3)])
    one = path.vertices.where("v = 1")
    assert flows.is_separator(path, one) and flows.is_minimal_separator(path, one) and not flows.is_minimal_separator(path, path.vertices.where("v in (1, 2)"))
    assert {(r.s, r.t): r.value for r in flows.st_vertex_connectivity(g, spark.createDataFrame([(2, 6)], "s long, t long")).collect()} == {(2, 6): 2}


def test_percolation_by_vertices(spark):
    g = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (2, 3)])
    order = spark.createDataFrame([(0, 0), (2, 1), (1, 2), (3, 3)], "v long, i long")
    assert [(r.giant, r.vertices) for r in flows.percolation(g, order, True).orderBy("i").collect()] == [(1, 1), (1, 2), (3, 3), (4, 4)]


def test_spectra_of_known_graphs(spark):
    n = 6
    full = {r.name: r.value for r in spectral.spectral_profile(Graph.from_lists(spark, n, list(combinations(range(n), 2)))).collect()}
    assert math.isclose(full["spectral_gap"], n, abs_tol=1e-9) and math.isclose(full["normalized_algebraic_connectivity"], n / (n - 1)) and math.isclose(full["distance_spectral_radius"], n - 1)
    path = Graph.from_lists(spark, 5, [(i, i + 1) for i in range(4)])
    assert all(math.isclose(r.resistance, r.v - r.u, abs_tol=1e-9) for r in spectral.effective_resistances(path).collect())
    cube = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 3)])
    assert math.isclose({r.name: r.value for r in spectral.spectral_profile(cube).collect()}["bipartiteness_ratio"], 0, abs_tol=1e-9)
    assert [round(r.value, 6) for r in spectral.eigen_adjacency(cube, 2, "LA").orderBy("i").collect()] == [2, 0]
    assert spectral.dim_select([9.0, 8.5, 8.8, 0.2, 0.1, 0.15]) == 3
    m = spark.createDataFrame([(0, 0, 2.0), (1, 1, 5.0)], "i long, j long, value double")
    assert [r.real for r in spectral.eigen_matrix(m, 2).orderBy("i").collect()] == [5.0, 2.0]


def test_embeddings_count_isomorphisms(spark):
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    g = Graph.from_lists(spark, 10, petersen)
    assert patterns.embeddings(g, patterns.PATTERNS["c5"]).count() == 12
    assert patterns.count_isomorphisms(Graph.from_lists(spark, 5, [(i, (i + 1) % 5) for i in range(5)]), patterns.PATTERNS["c5"]) == 10
    assert patterns.count_isomorphisms(g, patterns.PATTERNS["c5"]) == 0
    for name, pattern in patterns.PATTERNS.items():
        least = patterns.order_constraints(pattern)
        kept = [p for p in permutations(range(pattern[0])) if all(p[a] < p[b] for a, b in least)]
        assert len(kept) * len(patterns.automorphisms(pattern)) == math.factorial(pattern[0]), name


def graphical(degrees):
    left = sorted(degrees, reverse=True)
    while left and left[0] > 0:
        d, left = left[0], left[1:]
        if d > len(left):
            return False
        left = sorted([x - 1 for x in left[:d]] + left[d:], reverse=True)
        if left and left[-1] < 0:
            return False
    return True


def test_degree_conditions():
    rng = np.random.Generator(np.random.PCG64(8))
    runs = lambda ds: [(int(d), int(k)) for d, k in zip(*np.unique(ds, return_counts=True))]
    for _ in range(400):
        ds = rng.integers(0, 7, rng.integers(1, 8)).tolist()
        assert classes.is_graphical(runs(ds)) == graphical(ds), ds
    assert classes.is_graphical([(2, 1)], loops=True) and not classes.is_graphical([(2, 1)]) and classes.is_graphical([(2, 2)], multiple=True)
    assert classes.is_bigraphical([(2, 2)], [(2, 2)]) and not classes.is_bigraphical([(3, 1)], [(1, 1), (2, 1)]) and not classes.is_bigraphical([(1, 1)], [(2, 1)])
    assert classes.is_threshold([(3, 1), (1, 3)]) and not classes.is_threshold([(1, 4)]) and classes.is_split([(3, 1), (1, 3)]) and not classes.is_split([(2, 4)])


def test_classes_of_known_graphs(spark):
    of = lambda g: {r.name: r.value for r in classes.undirected_classes(g).collect()}
    wheel = of(Graph.from_lists(spark, 6, [(0, i) for i in range(1, 6)] + [(i, i % 5 + 1) for i in range(1, 6)]))
    assert wheel["is_wheel"] and not wheel["is_acyclic"] and not wheel["is_complete_bipartite"]
    k23 = of(Graph.from_lists(spark, 5, [(a, b) for a in (0, 1) for b in (2, 3, 4)]))
    assert k23["is_complete_bipartite"] and k23["is_biregular"] and not k23["is_split_graph"]
    lobster = of(Graph.from_lists(spark, 7, [(0, 1), (1, 2), (0, 3), (3, 4), (0, 5), (5, 6)]))
    assert lobster["is_lobster"] and lobster["is_spider"] and not lobster["is_caterpillar"]
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    assert classes.strongly_regular_parameters(Graph.from_lists(spark, 10, petersen)).collect() == [(10, 3, 0, 1)]
    widths = {r.name: r.value for r in classes.width_bounds(Graph.from_lists(spark, 5, [(i, (i + 1) % 5) for i in range(5)])).collect()}
    assert widths == {"treewidth_upper_bound": 2, "treewidth_min_fill": 2, "is_series_parallel": 1}


def test_layouts(spark):
    g = ring_of_cliques(spark, 3, 4)
    for method in (layout.layout_mds, layout.layout_kamada_kawai, layout.layout_fruchterman_reingold):
        at = {r.v: (r.x, r.y) for r in method(g).collect()}
        far = lambda a, b: math.dist(at[a], at[b])
        inside = [far(a, b) for a, b in combinations(range(12), 2) if a // 4 == b // 4]
        across = [far(a, b) for a, b in combinations(range(12), 2) if a // 4 != b // 4]
        assert len(at) == 12 and sum(inside) / len(inside) < sum(across) / len(across)
    aligned = layout.layout_align(layout.layout_mds(g)).agg(F.avg("x"), F.avg("y"), F.covar_pop("x", "y")).first()
    assert all(abs(x) < 1e-9 for x in aligned)


def test_random_models(spark):
    cells = random_models.bernoulli_cells(spark, 300, 300, 0.1, 1).count()
    assert abs(cells - 9000) < 6 * math.sqrt(9000 * 0.9)
    assert random_models.bernoulli_cells(spark, 5, 5, 1.0, 1).count() == 25 and random_models.bernoulli_cells(spark, 5, 5, 0.0, 1).isEmpty()
    assert sorted(r.x for r in random_models.distinct_numbers(spark, 10, 10, 3).collect()) == list(range(10))
    tree = random_models.tree_game_prufer(spark, 30, 2)
    assert tree.edges.count() == 29 and iterate.connected_components(tree).select("component").distinct().count() == 1
    with pytest.raises(ValueError):
        random_models.sample_negative_edges(Graph.from_lists(spark, 3, [(0, 1), (1, 2), (0, 2)]), 1)
