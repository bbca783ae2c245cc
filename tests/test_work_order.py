"""Work orders with large and small clusters: members are counted, and no item carries the list of its cluster."""

import pytest

from tarnwick.operators import recall

SCHEMA = "id string, domain string, kind string, label string, summary string, confidence_permille int, source_hints array<string>, reconciliation_keys array<string>, tags array<string>"


@pytest.fixture(scope="module")
def order(spark):
    """A cluster of 40 in one domain with two hints, a pair in two domains, a pair in one domain with three hints, a plain pair, one with no key."""
    row = lambda i, dom, hints, keys: (i, dom, "entity", i, "", 700, ["H", *hints], keys, [])
    rows = [row(f"a{i:02}", "plot", ["x"] if i % 2 else [], ["big", f"own{i}"]) for i in range(40)]
    rows += [row("b1", "plot", [], ["two"]), row("b2", "place", [], ["two"]), row("c1", "plot", ["x"], ["three"]), row("c2", "plot", ["y"], ["three"])]
    rows += [row("d1", "plot", [], ["plain"]), row("d2", "plot", [], ["plain"]), row("e1", "plot", [], [])]
    return recall.work_order(spark.createDataFrame(rows, SCHEMA), ["H"], 1)


def test_leverage_by_members_domains_and_hints(order):
    items, clusters = order
    got = {r.candidate_id: "high-leverage" in r.lanes for r in items.collect()}
    assert got == {k: k[0] in "abc" for k in [*(f"a{i:02}" for i in range(40)), "b1", "b2", "c1", "c2", "d1", "d2", "e1"]}
    of = {i: r.cluster_id for r in clusters.collect() for i in r.candidate_ids}
    assert {r.candidate_id: r.cluster_id for r in items.collect()} == of and len(set(of.values())) == 5
    assert {tuple(r.hints) for r in clusters.collect()} == {("H", "x"), ("H",), ("H", "x", "y")} and len(next(r for r in clusters.collect() if r.component == "a00")["keys"]) == 41


def test_no_list_of_ids_in_items(order):
    """The ids of a cluster used to stand in each of its items, so 10,000 members were 100 million ids."""
    plan = order[0].select("candidate_id", "priority", "lanes")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(id" not in plan and "candidate_ids" not in plan
    whole = order[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(candidate_ids" not in whole
