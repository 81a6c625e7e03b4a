"""Packed neighbour lists: each edge once, from one end, in few bytes; what queries on them read."""

import numpy as np
import pytest

from lattica.catalogue import bought, copurchase
from lattica.graph import Graph
from lattica.operators import lists, profile, triangles


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Line items of which many orders share pairs, one order has a part twice and some have none."""
    folder = tmp_path_factory.mktemp("tables")
    rows = [(o, (o * o + k * 7) % 60) for o in range(120) for k in range(o % 6)] + [(5, 5), (5, 5), (200, None), (None, 3), (201, 70)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def edges_of(found):
    keys = [lists.unpack(r.packed, r.n) for r in found.rows.collect()]
    owners = [set((k >> 32).tolist()) for k in keys]
    assert sum(map(len, owners)) == len(set().union(*owners))  # a vertex is in one row
    return sorted(((k >> 32) + found.low, (k & 0xFFFFFFFF) + found.low) for k in np.concatenate(keys).tolist())


def test_lists_hold_each_edge_once_from_one_end(spark, orders):
    found = lists.neighbour_lists(bought(spark, orders))
    expected = sorted((r.src, r.dst) for r in copurchase(spark, orders).edges.collect())
    assert edges_of(found) == expected and found.edges == len(expected)


def test_edges_are_sent_from_one_end_in_few_bytes(spark):
    n = 400
    e = spark.range(n).selectExpr("id as src").crossJoin(spark.range(n).selectExpr("id as dst")).where("src < dst and (src * dst + src) % 3 = 0")
    found = lists.neighbour_lists(Graph(spark.range(n).selectExpr("id as v"), e.union(e)))
    assert found.edges == e.count()
    assert found.rows.selectExpr("sum(length(packed)) as k").first().k < 4 * found.edges  # GROUPS small rows here; a pair of long is 16 bytes


def test_an_end_that_is_no_vertex_is_an_error(spark):
    g = Graph(spark.range(3).selectExpr("id as v"), spark.createDataFrame([(0, 9)], "src long, dst long"))
    with pytest.raises(Exception, match="no vertex"):
        lists.neighbour_lists(g)


@pytest.mark.parametrize("name", ["clustering", "local_scan", "triangle_totals"])
def test_pairs_need_not_be_distinct(spark, orders, name):
    run = getattr(triangles, name)
    assert sorted(map(str, run(bought(spark, orders)).collect())) == sorted(map(str, run(copurchase(spark, orders)).collect()))


def test_neighbour_degrees_need_no_stored_edges(spark, orders, monkeypatch):
    monkeypatch.setattr(lists, "EDGES", 100)
    got, want = ({r.name: r.value for r in profile.neighbor_degree_measures(f(spark, orders)).collect()} for f in (bought, copurchase))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * abs(want[k]) for k in want)
