"""Append-only ledgers: current rows, drift, freshness, plans, and idempotent appends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.operators import ranking


def latest(log: DataFrame, key: str, seq: Sequence[str]) -> DataFrame:
    """The last row of each key in append order; an aggregate, so summed before the shuffle."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.struct(*seq)).alias("_r")).select("_r.*")


def first_last_seen(log: DataFrame, key: str, at: str, seq: Sequence[str]) -> DataFrame:
    """first_seen and last_seen in append order: a late row does move last_seen back."""
    order = F.struct(*seq)
    return log.groupBy(key).agg(F.min_by(at, order).alias("first_seen"), F.max_by(at, order).alias("last_seen"), F.count("*").alias("n"))


def drift(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each row with what it changed against the row before: `changed`, an array of column names."""
    w = W.partitionBy(key).orderBy(*order)
    prev = {c: F.lag(c).over(w) for c in columns}
    n = F.row_number().over(w)
    parts = [F.when((n > 1) & ~F.col(c).eqNullSafe(p), F.lit(c)) for c, p in prev.items()]
    return log.withColumn("changed", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def last_drift(log: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, drift): whether the last row differs from the one before in any of the columns."""
    d = drift(log, key, order, columns)
    return d.groupBy(key).agg(F.max_by(F.size("changed") > 0, F.struct(*order)).alias("drift"))


def replay_origins(replays: DataFrame, successes: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Replays for which some success with equal keys is no later."""
    s = successes.groupBy(*keys).agg(F.min(at).alias("_first"))  # any earlier one will do, so the earliest
    return replays.join(s, list(keys)).where(F.col("_first") <= F.col(at)).drop("_first")


def append_new(log: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose content id the log has not, each once."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of their key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


# A ledger in folders by a hash of the id, so that an append need not read it whole.

#: Folders that the ids of an append are dealt to. A ledger that has grown may be given more: what it holds stays where it is.
BUCKETS = 64
_OF, _BUCKET = "_of", "_bucket"


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def _counts(spark: SparkSession, path: str) -> list[int]:
    """The numbers of folders that appends to this ledger were made with; none if there is no ledger yet."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/{_OF}=*")
    return sorted(int(f.getPath().getName().partition("=")[2]) for f in found.getFileSystem(conf).globStatus(found) or ())


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger that `append_stored` wrote."""
    return spark.read.parquet(path).drop(_OF, _BUCKET)


def stored_ids(new: DataFrame, path: str, key: str) -> DataFrame | None:
    """(_id) of the folders that the ids of `new` belong to, None if there is no ledger; no other folder and no other column is read.

    The folders' numbers go through the driver: at most as many as an append deals to.
    """
    spark = new.sparkSession
    counts = _counts(spark, path)
    if not counts:
        return None
    met = new.agg(*(F.collect_set(_bucket(key, n)) for n in counts)).first()
    asked = reduce(Column.__or__, ((F.col(_OF) == n) & F.col(_BUCKET).isin(list(m)) for n, m in zip(counts, met)))
    schema = f"`{key}` {new.schema[key].dataType.simpleString()}, {_OF} int, {_BUCKET} int"
    return spark.read.schema(schema).parquet(path).where(asked).select(F.col(key).alias("_id"))


def append_stored(new: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write the rows of new whose id the ledger has not, each id once; null counts as an id.

    What is read of the ledger are the ids in at most as many folders as new has ids. An append that was cut off and is made
    again adds what is lacking. ValueError if new has a column called `_of` or `_bucket`.
    """
    if {_OF, _BUCKET} & {c.lower() for c in new.columns}:
        raise ValueError(f"{_OF} and {_BUCKET} are the ledger's own columns")
    once = new.dropDuplicates([key])
    old = stored_ids(new, path, key)
    if old is not None:
        once = once.join(old, F.col(key).eqNullSafe(F.col("_id")), "left_anti")
    dealt = once.withColumns({_OF: F.lit(buckets), _BUCKET: _bucket(key, buckets)})
    dealt.repartition(_BUCKET).write.partitionBy(_OF, _BUCKET).mode("append").parquet(path)


def prior(requests: DataFrame, successes: DataFrame, keys: Sequence[str], at: str, name: str = "prior") -> DataFrame:
    """requests with `name`: the time of the last success with equal keys that is no later, null without one.

    A running maximum over both tables in one order: no range join, no product of a key's rows. Columns of requests only; null keys are equal, a null time has no prior.
    """
    both = requests.select(*(F.col(k) for k in keys), F.col(at).alias("_at"), F.struct(*requests.columns).alias("_row")).unionByName(
        successes.select(*keys, F.col(at).alias("_at")), allowMissingColumns=True
    )
    w = W.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    known = F.when(F.col("_row").isNull(), F.col("_at"))
    out = both.withColumn("_prior", F.when(F.col("_at").isNotNull(), F.max(known).over(w))).where("_row IS NOT NULL")
    return out.select("_row.*", F.col("_prior").alias(name))


def pending(work: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """(key) of work that no decision is about, each once; a null key stays pending."""
    return work.select(key).distinct().join(decided.select(key), key, "left_anti")


def histogram(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, n) for each of values, 0 where there is none."""
    n = df.where(F.col(column).isin(list(values))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    return spark.createDataFrame([(v,) for v in values], "value string").join(n, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


#: Days after which a status falls due again; None: not by itself (fixed values).
CADENCE = {"never-attempted": 0, "route-only": 180, "unavailable": 30, "blocked-robots": 90, "rejected-private-contact": 180, "rejected-oversize": 30, "error": 7}


def cadence_days(status: Column, refresh: Column) -> Column:
    out = F.when(status == "observed", refresh)
    for s, d in CADENCE.items():
        out = out.when(status == s, d)
    return out


def due_at(last: Column, days: Column) -> Column:
    """The time `days` after the last attempt, null where nothing falls due by itself."""
    return F.when(days.isNotNull(), F.timestamp_add("DAY", days.cast("int"), last))


def health_status(errors: Column, status: Column, route: Column, unknown_rights: Column, due: Column) -> Column:
    """The first that applies of eight states."""
    n = F.coalesce(route, F.lit(""))
    return (
        F.when(errors > 0, "integrity-error")
        .when((status == "retired") | (n == "retired"), "retired")
        .when((status == "blocked-rights") | (unknown_rights & (status == "never-attempted")) | (n == "terms-review"), "rights-review")
        .when(status == "never-attempted", "never-attempted")
        .when((status == "unavailable") | (n == "unavailable"), "unavailable")
        .when(status.isin("blocked-robots", "blocked-credential", "rejected-private-contact", "rejected-oversize", "error") | (n == "robots-deny"), "blocked")
        .when(F.coalesce(due, F.lit(False)), "due")
        .otherwise("fresh")
    )


#: What a state asks for, and how urgently (fixed values).
TASKS = {"never-attempted": ("collect", 70), "due": ("collect", 65), "unavailable": ("refresh-route", 68), "blocked": ("review-block", 60)}
REPAIRS = {"repair-ledger": 100, "repair-cache": 98, "repair-credit": 96}


def health_plan(records: DataFrame, repairs: DataFrame, limit: int = 40) -> DataFrame:
    """(source_id, task, priority, due_at) of records (source_id, status, integrity_errors, rights_review,
    drift, local_custody, due_at, route_checked_at) and repairs (source_id, task); most urgent first."""
    ok = records.where("integrity_errors = 0 AND status <> 'retired'")
    task = lambda df, name, p, due: df.select("source_id", name.alias("task"), p.cast("int").alias("priority"), due.alias("due_at"))
    urgency = F.lit(90)
    for name, p in REPAIRS.items():
        urgency = F.when(F.col("task") == name, p).otherwise(urgency)
    own, prio = F.lit(None).cast("string"), F.lit(None).cast("int")
    for s, (name, p) in TASKS.items():
        own, prio = F.when(F.col("status") == s, name).otherwise(own), F.when(F.col("status") == s, p).otherwise(prio)
    custody = (F.col("status") == "never-attempted") & F.col("local_custody")
    own, prio = F.when(custody, "request-local-custody").otherwise(own), F.when(custody, 55).otherwise(prio)
    none = F.lit(None).cast(records.schema["due_at"].dataType)
    parts = [
        task(repairs.distinct(), F.col("task"), urgency, none),
        task(ok.where("rights_review"), F.lit("review-rights"), F.lit(90), F.col("due_at")),
        task(ok.where("drift"), F.lit("inspect-drift"), F.lit(85), F.col("route_checked_at")),
        task(ok, own, prio, F.col("due_at")).where("task IS NOT NULL"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()
    return out.orderBy(F.desc("priority"), F.asc_nulls_last("due_at"), "source_id", "task").limit(max(0, limit))


def plan(ledger: DataFrame, now: Column, cursor: int, limit: int = 20, refresh: bool = False) -> DataFrame:
    """Sources to attempt: eligible ones, never attempted first, rotated by the cursor.

    Places in the order are found by ranges; only the rows of this turn, at most `limit`, meet in one task.
    """
    eligible = ledger.where((F.col("status") != "retired") & (F.lit(refresh) | (F.col("status") == "never-attempted") | F.coalesce(F.col("next_eligible_at") <= now, F.lit(False))))
    order = [F.when(F.col("status") == "never-attempted", 0).otherwise(1), F.col("last_attempt_at").asc_nulls_first(), F.col("source_id").asc()]
    n = eligible.count()
    if not n:
        return eligible.limit(0)
    turn = F.pmod(F.col("_place") - 1 - cursor % n, F.lit(n))
    return ranking.placed(eligible, [], order, "_place", count=n).withColumn("_place", turn).where(F.col("_place") < limit).orderBy("_place").drop("_place")


# Robots rules.


def robots_allows(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path_id, allowed, rule) for paths (path_id, agent, path) and rules (agent, prefix, allow).

    Rules for the agent's own group if it has one, else for `*`; the longest prefix wins, allow wins
    ties, and without any rule the path is allowed. Prefixes are joined by equality: each path
    meets rules at its own prefixes only.
    """
    own = rules.select("agent").distinct()
    p = paths.join(own.withColumn("_own", F.lit(True)), "agent", "left")
    p = p.withColumn("_group", F.when(F.col("_own"), F.col("agent")).otherwise("*")).drop("_own")
    cuts = p.select("path_id", "_group", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring("path", F.lit(1), i))).alias("prefix"))
    hits = cuts.join(rules.withColumnRenamed("agent", "_group"), ["_group", "prefix"])
    best = hits.groupBy("path_id").agg(F.max(F.struct(F.length("prefix").alias("l"), F.col("allow").cast("int").alias("a"), "prefix")).alias("b"))
    return paths.join(best, "path_id", "left").select("path_id", F.coalesce(F.col("b.a") == 1, F.lit(True)).alias("allowed"), F.col("b.prefix").alias("rule"))
