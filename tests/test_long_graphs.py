"""Graphs whose longest way has more than a hundred edges."""

import pytest

from tarnwick.operators import graph

N = 150


@pytest.fixture
def quick(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double").coalesce(1)


def test_closure_of_a_chain(quick):
    start = quick.createDataFrame([(0,)], "node long").coalesce(1)
    chain = edges(quick, [(i, i + 1) for i in range(N)])
    assert {r.node for r in graph.closure(chain, start).collect()} == set(range(N + 1))


def test_distances_of_a_chain(quick):
    start = quick.createDataFrame([(0,)], "node long").coalesce(1)
    chain = edges(quick, [(i, i + 1) for i in range(N)])
    assert {r.node: r.distance for r in graph.shortest(chain, start).collect()} == {i: i for i in range(N + 1)}


def test_rounds_that_do_not_do(quick):
    start = quick.createDataFrame([(0,)], "node long").coalesce(1)
    with pytest.raises(RuntimeError):
        graph.closure(edges(quick, [(i, i + 1) for i in range(9)]), start, 3)


def test_ring(quick):
    ring = edges(quick, [(i, (i + 1) % N) for i in range(N)])
    assert {r.node for r in graph.cycle_nodes(ring).collect()} == set(range(N))
