from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import ledger
from tarnwick.streaming import ledger as S


def _events(spark, path):
    rows = [(1, datetime(2024, 1, 1, 0, 5), 7, "a", 1.0), (2, datetime(2024, 1, 1, 0, 20), 7, "b", 2.0), (3, datetime(2024, 1, 1, 3, 0), 8, "a", 4.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.mode("append").parquet(path)


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_append_once_twice(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    _events(spark, src)
    for n in range(2):
        q = S.append_once(S.stream_events(spark, src), out, str(tmp_path / f"c{n}"))
        q.awaitTermination(120)
    assert ledger.stored(spark, out).count() == 3


def test_stored_ledger_reads_the_batch_s_folders(spark, tmp_path):
    out = str(tmp_path / "log")
    ids = lambda *r: spark.range(*r).selectExpr("id AS event_id", "id % 7 AS v")
    ledger.append_stored(ids(0, 500), out, "event_id", 16)
    one = ids(123, 124)
    old = ledger.stored_ids(one, out, "event_id")
    folders = {r[0].rsplit("/", 2)[1] for r in old.select(F.input_file_name()).distinct().collect()}
    assert len(folders) == 1 and 0 < old.count() < 100
    assert ledger.stored_ids(ids(0), out, "event_id").count() == 0
    # more folders from now on; ids of the earlier ones are still known, repeats and nulls are kept once
    more = ids(400, 900).unionByName(ids(890, 900)).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS event_id, 1L AS v"))
    for _ in range(2):
        ledger.append_stored(more, out, "event_id", 64)
    got = sorted((r.event_id is None, r.event_id or 0) for r in ledger.stored(spark, out).collect())
    assert got == [(False, k) for k in range(900)] + [(True, 0)]
    assert sorted(ledger.stored(spark, out).columns) == ["event_id", "v"]
    with pytest.raises(ValueError):
        ledger.append_stored(one.withColumn("_bucket", F.lit(1)), out, "event_id")


def test_prior_and_pending(spark):
    r = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 3)], "id int, k string, at int")
    s = spark.createDataFrame([("a", 3), ("a", 4), ("a", 9), ("c", 1), ("b", None), (None, 2)], "k string, at int")
    assert {x.id: x.prior for x in ledger.prior(r, s, ["k"], "at").collect()} == {1: 4, 2: None, 3: None, 4: 2, 5: None, 6: 3}
    assert ledger.prior(r.limit(0), s, ["k"], "at").count() == 0
    w = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted((x.k is None, x.k or 0) for x in ledger.pending(w, w.where("k = 2"), "k").collect()) == [(False, 1), (True, 0)]


def test_windows_and_status(spark, tmp_path):
    src = str(tmp_path / "in")
    _events(spark, src)
    _run(S.first_of_each(S.stream_events(spark, src)), "once", "append")
    assert spark.table("once").count() == 3
    _run(S.status_machine(S.stream_events(spark, src)), "status", "update")
    got = {r.user_id: (r.status, r.seen, r.changes) for r in spark.table("status").collect()}
    assert got == {7: ("b", 2, 1), 8: ("a", 1, 0)}
    _run(S.windowed_counts(S.stream_events(spark, src)), "win", "append")
    assert spark.table("win").agg(F.sum("n")).first()[0] in (None, 2)
