"""Places found by ranges equal those of a window, and no range holds what a hot group holds."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.operators import corpus, ledger, ranking


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["hot", "hot", "hot", "a", None, ""]), rng.choice(["x", "y"]), rng.choice([None, *range(400)])) for i in range(6000)]
    return spark.createDataFrame(data, "id long, grp string, head string, at int")


@pytest.mark.parametrize("group", [[], ["grp"], ["grp", "head"]])
@pytest.mark.parametrize("per_range", [200, 10**6])
def test_equals_a_window(rows, group, per_range):
    order = [F.col("at").desc_nulls_first(), "id"]
    got = ranking.placed(rows, group, order, per_range=per_range)
    window = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.withColumn("place", window.cast("long")).collect()), key=str)


def test_hot_groups_and_equal_rows_are_split(spark):
    same = spark.range(20000).select(F.lit("hot").alias("grp"), F.lit(1).alias("at"))
    got = ranking.placed(same, ["grp"], ["at"], per_range=1000)
    assert got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place")).first() == (20000, 20000, 1, 20000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" in plan[plan.index("Window [") :]
    files = [f for f in got.inputFiles() if f.endswith(".parquet")]
    sizes = [spark.read.parquet(f).count() for f in files]
    assert sum(sizes) == 20000 and len(sizes) >= 15 and max(sizes) < 4000


def test_clashing_names_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 9, "a", 0.5), (2, 8, "a", 0.5)], "part long, place int, row string, _tie double")
    assert sorted(map(tuple, ranking.placed(rows, ["row"], [F.desc("part")]).collect())) == [(1, "a", 0.5, 2), (2, "a", 0.5, 1)]
    empty = ranking.placed(rows.limit(0), ["row"], ["part"])
    assert empty.columns == ["part", "row", "_tie", "place"] and empty.count() == 0


def test_the_row_before(rows):
    got = ranking.before(ranking.placed(rows, ["grp"], ["id"], per_range=500), ["grp"], "place", ["id"])
    window = F.lag("id").over(W.partitionBy("grp").orderBy("id"))
    assert sorted(map(tuple, got.select("id", "before_id").collect())) == sorted(map(tuple, rows.select("id", window).collect()))


def test_narrative_order_and_turns(rows, spark):
    got = corpus.narrative_order(rows, "grp", "head", ["id"])
    by = lambda *g: F.row_number().over(W.partitionBy(*g).orderBy("id")).cast("long")
    want = rows.select("id", by("grp", "head"), by("grp"))
    assert sorted(map(tuple, got.select("id", "heading_occurrence", "chapter_order").collect())) == sorted(map(tuple, want.collect()))
    log = spark.createDataFrame([(f"s{i:02}", "observed", None, None) for i in range(10)], "source_id string, status string, last_attempt_at timestamp, next_eligible_at timestamp")
    turn = lambda cursor, limit: [r.source_id for r in ledger.plan(log, F.current_timestamp(), cursor, limit, refresh=True).collect()]
    assert turn(8, 4) == ["s08", "s09", "s00", "s01"] and turn(23, 2) == ["s03", "s04"] and len(turn(3, 40)) == 10 and turn(3, 40)[0] == "s03" and turn(0, 0) == []
