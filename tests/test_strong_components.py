"""Strong components against plain search, on random graphs, rings and chains."""

import random

import pytest

from tarnwick.operators import graph


def brute(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {d for s, d in edges if s == n} for n in nodes}

    def reach(n):
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    far = {n: reach(n) for n in nodes}
    return {(n, min(m for m in far[n] if n in far[m])) for n in nodes if n in far[n]}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("seed, n, m", [(2, 40, 45), (3, 60, 70), (4, 25, 80)])
def test_random_graphs(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    assert {tuple(x) for x in graph.strong_components(frame(spark, edges)).collect()} == brute(edges)


def test_knots_tails_and_loops(spark):
    """Rings that share a node, rings joined one way, a ring with tails on both sides, loops on chains, copies of edges, null ends."""
    ring = lambda ids: list(zip(ids, [*ids[1:], ids[0]], strict=True))
    edges = ring([1, 2, 3]) + ring([3, 4, 5]) + ring([10, 11]) + [(5, 10)] + [(20, 21), (21, 1), (11, 30), (30, 31)]
    edges += [(30, 30), (40, 40), (50, 51), (51, 51), (51, 52), (1, 2), (1, 2)]
    got = graph.strong_components(frame(spark, [*edges, (None, 1), (2, None)])).collect()
    assert sorted(map(tuple, got)) == sorted(brute(edges)) and (1, 1) in {tuple(x) for x in got}
    assert graph.strong_components(frame(spark, [])).collect() == []
    assert {r.node for r in graph.cycle_nodes(frame(spark, edges)).collect()} == {n for n, _ in brute(edges)}


def test_a_ring_of_many_nodes(spark):
    """100,000 nodes in a ring and as many in a chain that leads there: edges are shuffled, never pairs."""
    n = 100_000
    ring = spark.range(n).selectExpr("id * 7919 % 100000 AS src", "(id + 1) % 100000 * 7919 % 100000 AS dst")
    chain = spark.range(n).selectExpr("id + 100000 AS src", "CASE WHEN id = 99999 THEN 5 ELSE id + 100001 END AS dst")
    got = graph.strong_components(ring.union(chain))
    assert got.count() == n and got.where("component <> 0 OR node >= 100000").count() == 0
