"""Graph queries and fingerprints over whole tables against brute force on small fixtures."""

import random
from collections import defaultdict

import pytest

from tarnwick.plans.catalogue import QUERIES

@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A lineitem of a few links, and the suppliers that share a part with each."""
    r = random.Random(4)
    rows = [(i, r.randrange(60), r.randrange(90)) for i in range(1, 80)]
    at = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{at}/lineitem.parquet")
    by_part = defaultdict(set)
    for _, s, p in rows:
        by_part[p].add(s)
    near = {s: set().union(*(x for x in by_part.values() if s in x)) for _, s, _ in rows}
    return at, near


def walk(near, starts):
    depth, front = dict.fromkeys(starts, 0), set(starts)
    while front:
        front = {y for x in front for y in near[x]} - set(depth)
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    return depth


def test_components_of_all_lines(spark, lines):
    at, near = lines
    want = {s: min(walk(near, [s])) for s in near}
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, at).collect()} == want and len(set(want.values())) > 1


def test_depths_over_all_lines(spark, lines):
    at, near = lines
    want = {s: k for s, k in walk(near, [s for s in near if s % 20 == 0]).items() if k <= 2}
    assert {r.node: r.depth for r in QUERIES["key_bfs_depth"](spark, at).collect()} == want and len(set(want.values())) == 3


def fnv(text):
    h, raw = 2166136261, text.encode("utf-16-be") + b"\0\x1f"
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return f"fnv1a32:{h:08x}"


def test_fingerprints_of_whole_texts(spark, tmp_path):
    same = "one beginning of é😀 " * 20
    texts = {1: same + "a", 2: same + "b", 3: "short", 4: "", 5: "long " * 20_000, 6: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.fnv for r in QUERIES["fingerprint_fnv1a"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else fnv(t) for i, t in texts.items()} and len(set(got.values())) == 6
