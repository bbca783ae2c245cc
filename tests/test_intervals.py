"""Pairs of overlapping intervals equal those of comparing all with all, each once, without a nested loop."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import intervals, validate


def _some(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        a = rng.choice([rng.randint(-500, 500), rng.randint(-(10**6), 10**6), 64])
        b = a + rng.choice([0, 1, rng.randint(0, 50), rng.randint(0, 10**6), -3])
        out.append((i, rng.choice(["x", "x", "y", None]), rng.choice([a, a, a, a, None]), b))
    return out


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_against_brute_force(spark, keys):
    a, b = _some(300, 1), _some(250, 2)
    schema = "id int, k string, lo long, hi long"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ("lo", "hi"), ("lo", "hi"), keys)
    ok = lambda r: r[2] is not None and r[2] <= r[3]
    want = sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[2] <= y[3] and y[2] <= x[3] and (not keys or x[1] is not None and x[1] == y[1]))
    assert sorted(map(tuple, got.select("left.id", "right.id").collect())) == want and len(want) > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_types_ties_and_empty(spark):
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 5)), (date(2024, 1, 1), date(2024, 1, 5))], "a date, b date")
    more = spark.createDataFrame([(date(2024, 1, 5), date(2024, 1, 5)), (date(2024, 1, 6), date(2024, 1, 7))], "a date, b date")
    join = lambda x, y: intervals.overlap_join(x, y, ("a", "b"), ("a", "b"))
    assert join(days, more).count() == 2 and join(days, days).count() == 4
    for kind in ("timestamp", "timestamp_ntz"):
        t = spark.createDataFrame([(datetime(1969, 12, 31, 23), datetime(1970, 1, 1, 1))], "a timestamp_ntz, b timestamp_ntz").select(F.col("a").cast(kind), F.col("b").cast(kind))
        assert join(t, t).count() == 1
    assert join(days.limit(0), more).count() == 0 and join(days, more.limit(0)).count() == 0
    with pytest.raises(ValueError):
        join(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), days)


def test_causal_time(spark):
    rows = [("p", 10, 20, []), ("after", 21, 30, ["p"]), ("touch", 20, 30, ["p"]), ("either", 15, 30, ["p"]), ("before", 1, 9, ["p", "p"]), ("open", None, 5, ["p"]), ("lost", 1, 2, ["nobody"])]
    events = spark.createDataFrame(rows, "id string, earliest int, latest int, causal_parent_event_ids array<string>")
    got = {(r.code, r.severity, r.subject, r.detail) for r in validate.causal_time(events).collect()}
    assert got == {("causal-time-ambiguous", "warning", "either", "p"), ("causal-time", "error", "before", "p"), ("causal-time", "error", "open", "p")}
