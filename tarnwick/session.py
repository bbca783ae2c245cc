"""Session, table access and lineage cuts shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
ROOT = str(Path(__file__).resolve().parents[1])


def build_session(app: str = "tarnwick", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is named and all run on this machine.

    RuntimeError on a cluster that names none: what one machine writes, others could not read.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="tarnwick-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str = "t") -> str:
    """The path of a new folder in the shared one, which `clean_up` deletes."""
    path = f"{shared_dir(spark)}/tarnwick-{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def frugal(spark: SparkSession) -> Iterator[None]:
    """Settings for writes in here: shuffle files go when a write ends, not when the driver happens to collect its garbage; Python gets small batches."""
    given = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    was = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly where the scan has fewer tasks than there are cores.

    That is so for small files only; a table of many splits is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clean_up(spark: SparkSession) -> int:
    """Delete what `materialise` wrote in this process; call it when results have been stored elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
