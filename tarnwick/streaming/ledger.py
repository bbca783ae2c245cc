"""Ledgers as streams: idempotent ingestion, windows over events, and a keyed status machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwick.operators.ledger import BUCKETS, append_stored


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as they arrive, with ts as a TIMESTAMP so that it can carry a watermark."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each content id once; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows, once they are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_once(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", buckets: int = BUCKETS) -> StreamingQuery:
    """Write a stream to a ledger that `operators.ledger.stored` reads; a batch that is run again adds nothing.

    Each batch is compared with the ids of its own folders only, so what is read follows the batch.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        append_stored(batch, path, key, buckets)

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUS = "user_id long, status string, seen long, changes long"


def status_machine(events: DataFrame, order: str = "ts") -> DataFrame:
    """The last status of each user in event order, how often it was seen and how often it changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, seen, changes = state.get if state.exists else ("", 0, 0)
        for batch in batches:
            for value in batch.sort_values([order, "event_id"])["event_type"]:
                changes += int(seen > 0 and value != status)
                status, seen = value, seen + 1
        state.update((status, seen, changes))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "seen": [seen], "changes": [changes]})

    return events.groupBy("user_id").applyInPandasWithState(step, STATUS, "status string, seen long, changes long", "update", "NoTimeout")
