"""Small graphs with known answers, round trips of files, edge cases."""

import math
import random

import pytest

from lattica.graph import Graph
from lattica.operators import algebra, degree, distances, iterate, kernels, recognise, triangles
from lattica.plans import constructors as made
from lattica.plans import random_graphs
from lattica.sources import formats


def named(df):
    return {r.name: r.value for r in df.collect()}


def pairs(g):
    return sorted((r.src, r.dst) for r in g.edges.collect())


def test_loops_and_parallel_edges_count(spark):
    g = Graph.from_lists(spark, 4, [(0, 1), (1, 0), (2, 2)])
    assert {r.v: r.d for r in g.degrees().collect()} == {0: 2, 1: 2, 2: 2, 3: 0}
    assert pairs(algebra.simplify(g)) == [(0, 1)]
    flags = {r.eid: (r.is_loop, r.is_multiple, r.count_multiple) for r in algebra.edge_flags(g).collect()}
    assert flags == {0: (False, False, 2), 1: (False, True, 2), 2: (True, False, 1)}


def test_empty_graph(spark):
    g = Graph.from_lists(spark, 3, [(0, 0)])
    g = algebra.simplify(g)
    assert g.edges.isEmpty()
    assert {r.component for r in iterate.connected_components(g).collect()} == {0, 1, 2}
    assert named(degree.edge_indices(g, ["randic_index", "multiplicative_ga"])) == {"randic_index": 0.0, "multiplicative_ga": 1.0}
    assert {r.coreness for r in iterate.coreness(g).collect()} == {0}


def test_petersen(spark):
    g = made.generalized_petersen(spark, 5, 2)
    facts = named(recognise.facts(g))
    assert facts["is_cubic"] and facts["is_connected"] and facts["is_simple"] and not facts["is_tree"]
    assert recognise.is_triangle_free(g) and not recognise.is_bipartite(g)
    assert [r.girth for r in kernels.girth(g).collect()] == [5]
    values = named(kernels.spectral_measures(g).select("name", "value"))
    assert round(values["spanning_tree_count"]) == 2000 and math.isclose(values["algebraic_connectivity"], 2.0)
    assert named(distances.distance_indices(g))["diameter"] == 2.0


def test_components_and_scc_against_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(55)]
    out = {i: set() for i in range(60)}
    for a, b in edges:
        out[a].add(b)

    def reach(start, near):
        seen, stack = {start}, [start]
        while stack:
            for u in near[stack.pop()] - seen:
                seen.add(u)
                stack.append(u)
        return seen

    both = {i: set(out[i]) for i in out}
    for a in out:
        for b in out[a]:
            both[b].add(a)
    g = Graph.from_lists(spark, 60, edges, directed=True)
    assert {r.v: r.component for r in iterate.connected_components(g).collect()} == {v: min(reach(v, both)) for v in out}
    forward = {v: reach(v, out) for v in out}
    want = {v: min(u for u in forward[v] if v in forward[u]) for v in out}
    assert {r.v: r.component for r in iterate.strongly_connected_components(g).collect()} == want


def test_core_truss_cliques_colours(spark):
    g = Graph.from_lists(spark, 6, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5)])
    assert {r.v: r.coreness for r in iterate.coreness(g).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 4: 1, 5: 1}
    truss = {(r.a, r.b): r.truss for r in iterate.trussness(g).collect()}
    assert truss[(0, 1)] == 4 and truss[(4, 5)] == 2
    assert sorted(r.clique for r in kernels.maximal_cliques(g).collect()) == [[0, 1, 2, 3], [3, 4], [4, 5]]
    colour = {r.v: r.color for r in kernels.greedy_coloring(g).collect()}
    assert max(colour.values()) == 3 and all(colour[a] != colour[b] for a, b in pairs(g))
    cut = [(r.kind, r.id) for r in kernels.cut_points(g).collect() if r.kind != "edge"]
    assert sorted(cut) == [("articulation", 3), ("articulation", 4), ("bridge", 6), ("bridge", 7)]
    assert triangles.list_triangles(g).count() == 4


def test_weighted_paths_flow_and_forest(spark):
    g = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (0, 2), (2, 3)], True, [1.0, 1.0, 5.0, 2.0])
    start = g.vertices.where("v = 0")
    assert {r.t: r.dist for r in distances.weighted_distances(g, start).collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: 4.0}
    assert {r.t: r.width for r in distances.widest_paths(g, start).collect()}[3] == 2.0
    flow = kernels.st_flows(g, spark.createDataFrame([(0, 3)], "s long, t long"), "weight").first()
    assert flow.value == 2.0
    forest = iterate.minimum_spanning_forest(Graph.from_edges(g.edges, False, g.vertices))
    assert sorted(r.eid for r in forest.collect()) == [0, 1, 3]
    with pytest.raises(ValueError):
        iterate.topological_levels(Graph.from_lists(spark, 2, [(0, 1), (1, 0)], True))
    with pytest.raises(ValueError):
        distances.weighted_distances(Graph.from_lists(spark, 2, [(0, 1), (1, 0)], True, [-1.0, -1.0]), spark.range(1).selectExpr("id as v")).collect()


def test_random_graphs_repeat_and_fit(spark):
    a, b = random_graphs.erdos_renyi_gnp(spark, 200, 0.1, 5), random_graphs.erdos_renyi_gnp(spark, 200, 0.1, 5)
    assert pairs(a) == pairs(b)
    assert 1700 < a.edges.count() < 2300
    assert random_graphs.erdos_renyi_gnm(spark, 50, 100, 2).edges.select("src", "dst").distinct().count() == 100
    near = random_graphs.random_geometric(spark, 150, 0.1, 4)
    assert near.edges.where("src >= dst").isEmpty()
    d = spark.range(40).selectExpr("id as v", "3L as d")
    assert {r.d for r in random_graphs.configuration_model(d, 1).degrees().collect()} == {3}


@pytest.mark.parametrize("kind", ["edges", "ncol", "lgl", "net", "graphml", "gml"])
def test_files_come_back(spark, tmp_path, kind):
    g = Graph.from_lists(spark, 4, [(0, 1), (1, 2), (2, 3), (0, 3)])
    write = {"edges": formats.write_edgelist, "ncol": formats.write_ncol, "lgl": formats.write_lgl, "net": formats.write_pajek, "graphml": formats.write_graphml, "gml": formats.write_gml}[kind]
    folder = str(tmp_path / f"g.{kind}")
    write(g).coalesce(1).write.text(folder)
    assert pairs(formats.read_graph(spark, folder)) == pairs(g)


def test_dimacs(spark, tmp_path):
    g = Graph.from_lists(spark, 3, [(0, 1), (1, 2)], True, [4.0, 2.0])
    formats.write_dimacs(g, 0, 2).coalesce(1).write.text(str(tmp_path / "f"))
    back, s, t = formats.read_dimacs(spark, str(tmp_path / "f"))
    assert (s, t, pairs(back)) == (0, 2, pairs(g))


def test_fixed_points_of_the_copurchase_graph_run_to_their_end(spark, tmp_path):
    from lattica.catalogue import CATALOGUE

    n = 24
    baskets = [(o, p) for o in range(n - 1) for p in (o + 1, o + 2)] + [(99, 1), (99, 7), (99, 13)]
    spark.createDataFrame([(o, p, 1, 1, 1.0) for o, p in baskets], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {v: set() for v in range(1, n + 1)}
    for o, p in baskets:
        for q in (b for a, b in baskets if a == o and b != p):
            near[p].add(q)
    rank = {v: 1 / n for v in near}
    for _ in range(2000):
        rank = {v: 0.15 / n + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
    got = {r.v: r["rank"] for r in CATALOGUE["pagerank_converged"].run(spark, str(tmp_path)).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-7 for v in rank)
    hub = {v: 1.0 for v in near}
    for _ in range(50):
        authority = {v: sum(hub[u] for u in near[v]) for v in near}
        hub = {v: sum(authority[u] for u in near[v]) for v in near}
        hub = {v: x / max(hub.values()) for v, x in hub.items()}
    got = {r.v: r.hub for r in CATALOGUE["hub_and_authority_scores"].run(spark, str(tmp_path)).collect()}
    assert all(abs(got[v] - hub[v]) < 1e-6 for v in hub)
    label = {v: v for v in near}
    for _ in range(20):
        votes = {v: [label[v], *[label[u] for u in near[v]]] for v in near}
        label = {v: min(set(x), key=lambda y: (-x.count(y), y)) for v, x in votes.items()}
    assert {r.v: r.label for r in CATALOGUE["label_propagation"].run(spark, str(tmp_path)).collect()} == label
