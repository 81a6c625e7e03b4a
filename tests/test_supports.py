"""Triangles counted by blocks of vertices, against brute force."""

import random

import pytest

from lattica.graph import Graph
from lattica.operators import algebra, profile, triangles


@pytest.fixture(params=[(1, 1), (1, 40), (10_000_000_019, 40)], ids=["whole", "blocks", "wide"])
def graph(request, spark, monkeypatch):
    """A graph with loops and copies in one block or many, also with ids that are far apart; its edges by vertex."""
    step, parts = request.param
    rng = random.Random(4)
    pairs = [(rng.randrange(40) * step - 7, rng.randrange(40) * step - 7) for _ in range(260)] + [(-7, v * step - 7) for v in range(1, 40)]
    monkeypatch.setattr(triangles, "SLOTS", 4 * 260 // parts + 1)
    monkeypatch.setattr(triangles, "PLACES", 50)
    near = {v * step - 7: set() for v in range(42)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    vertices = spark.createDataFrame([(v,) for v in near], "v long")
    return near, Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"), False, vertices)


def triangles_at(near, v):
    return sum(b in near[a] for a in near[v] for b in near[v] if a < b)


def test_edge_support(graph):
    near, g = graph
    rows = triangles.edge_support(g).collect()
    assert len(rows) == sum(map(len, near.values())) // 2
    assert {(r.a, r.b): r.support for r in rows} == {(a, b): len(near[a] & near[b]) for a in near for b in near[a] if a < b}


def test_clustering(graph):
    near, g = graph
    rows = triangles.clustering(g).collect()
    assert len(rows) == 42 and {r.v: (r.degree, r.triangles) for r in rows} == {v: (len(near[v]), triangles_at(near, v)) for v in near}
    assert {r.v for r in rows if r.transitivity is None} == {v for v in near if len(near[v]) < 2}


def test_triangle_totals(graph):
    near, g = graph
    got = {r.name: r.value for r in triangles.triangle_totals(g).collect()}
    assert got["count_triangles"] * 3 == sum(triangles_at(near, v) for v in near)


def test_local_scan(graph):
    near, g = graph
    assert {r.v: r.local_scan for r in triangles.local_scan(g).collect()} == {v: len(near[v]) + triangles_at(near, v) for v in near}


def test_clustering_profile(graph):
    near, g = graph
    got = {r.name: r.value for r in profile.clustering_profile(algebra.simplify(g)).collect()}
    open_too = sum(len(x) * (len(x) - 1) // 2 for x in near.values())
    assert abs(got["closed_triplet_ratio"] - sum(triangles_at(near, v) for v in near) / open_too) < 1e-12


def test_neighbor_degree_measures(graph):
    near, g = graph
    got = {r.name: r.value for r in profile.neighbor_degree_measures(algebra.simplify(g)).collect()}
    assert got["first_ve_degree_zagreb_alpha"] == sum((sum(len(near[u]) for u in near[v]) - triangles_at(near, v)) ** 2 for v in near)
