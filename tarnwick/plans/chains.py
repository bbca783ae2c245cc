"""Queries over chains of the driver's tables, custody from region to line and orders in time, each beside its SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import corpus, cover, custody, intervals, ranking, validate
from tarnwick.operators.custody import Link
from tarnwick.plans.catalogue import ORACLES, query
from tarnwick.session import table


def fact_links(spark: SparkSession, d: str) -> list[Link]:
    """Regions, their nations, customers, orders and lines, each sealed with the digest of the one before."""
    of = lambda name: table(spark, d, name)
    lines = of("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"), "l_orderkey", "l_partkey", "l_suppkey")
    return custody.seal([
        Link("region", of("region"), ["r_name"], "r_regionkey"), Link("nation", of("nation"), ["n_name"], "n_nationkey", "n_regionkey"),
        Link("customer", of("customer"), ["c_name", "c_mktsegment"], "c_custkey", "c_nationkey"), Link("order", of("orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", "o_custkey"),
        Link("line", lines, ["l_partkey", "l_suppkey"], "line", "l_orderkey"),
    ])


#: Where faults are planted: customers changed after sealing, orders replaced by others that were sealed anew, orders lost, orders that came twice.
CHANGED, REPLACED, LOST, TWICE = "c_custkey % 89 = 7", "o_orderkey % 101 = 3", "o_orderkey % 103 = 9", "o_orderkey % 107 = 5"


def faulty_links(spark: SparkSession, d: str) -> list[Link]:
    region, nation, customer, order, line = fact_links(spark, d)
    # null where a key is null: such rows are not changed
    at = lambda where: F.coalesce(F.expr(where), F.lit(False))
    customers = customer.table.withColumn("c_mktsegment", F.when(at(CHANGED), F.concat(F.lit("NEW "), F.coalesce("c_mktsegment", F.lit("")))).otherwise(F.col("c_mktsegment")))
    orders = order.table.where(~at(LOST)).withColumn("o_orderstatus", F.when(at(REPLACED), F.concat(F.lit("NEW "), F.coalesce("o_orderstatus", F.lit("")))).otherwise(F.col("o_orderstatus")))
    orders = orders.withColumn(order.stored, F.when(at(REPLACED), custody.link_digest(order)).otherwise(F.col(order.stored)))
    orders = orders.unionByName(orders.where(at(TWICE)))
    return [region, nation, dataclasses.replace(customer, table=customers), dataclasses.replace(order, table=orders), line]


_FAULTS = f"""lines AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line, o_orderkey, c_custkey, n_regionkey,
  o_orderkey IS NULL AS lost, o_orderkey IS NOT NULL AND c_custkey IS NULL AS astray, coalesce({CHANGED}, false) AS changed, coalesce({REPLACED}, false) AS replaced, coalesce({TWICE}, false) AS twice
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE NOT ({LOST})) ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""


@query(f"""WITH {_FAULTS}
SELECT 'chain-own' AS code, 'error' AS severity, CAST(c_custkey AS VARCHAR) AS subject, 'customer ' || n_regionkey AS detail FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE {CHANGED}
UNION ALL SELECT CASE WHEN lost THEN 'chain-missing' WHEN twice THEN 'chain-ambiguous' ELSE 'chain-link' END, 'error', line, 'line' || coalesce(' ' || n_regionkey, '') FROM lines WHERE lost OR twice OR replaced""")
def fact_chain_findings(spark: SparkSession, d: str) -> DataFrame:
    """Each fault at the link where it is: changed customers, and lines whose order was replaced, lost or doubled."""
    return custody.chain_findings(faulty_links(spark, d))


@query(f"""WITH {_FAULTS}, b AS (SELECT CAST(n_regionkey AS VARCHAR) AS root, CASE WHEN lost THEN 'line' WHEN changed THEN 'customer' WHEN twice OR replaced THEN 'line' END AS level,
  CASE WHEN lost THEN 'missing' WHEN changed THEN 'own' WHEN twice THEN 'ambiguous' WHEN replaced THEN 'link' END AS cause, CASE WHEN lost THEN line WHEN changed THEN CAST(c_custkey AS VARCHAR) WHEN twice OR replaced THEN line END AS at_id FROM lines)
SELECT root, level, cause, count(*) AS lines, count(DISTINCT at_id) AS faults FROM b GROUP BY 1, 2, 3""")
def fact_chain_reach(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each region by the first fault on their way from it: whole ones (null), and those below a changed, replaced, lost or doubled link."""
    seen = custody.trace(faulty_links(spark, d))["line"]
    return seen.groupBy("root", F.col("at_level").alias("level"), F.col("at_cause").alias("cause")).agg(F.count("*").alias("lines"), F.count_distinct("at_id").alias("faults"))


# Orders in time: each runs from its date to its last shipment.

_RANGES = "r AS (SELECT o_orderkey, o_custkey, o_orderdate AS earliest, max(l_shipdate) AS latest FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("latest"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("earliest"))
    return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(f"""WITH {_RANGES} SELECT a.o_custkey AS custkey, count(*) AS pairs, sum(date_diff('day', CAST(greatest(a.earliest, b.earliest) AS DATE), CAST(least(a.latest, b.latest) AS DATE))) AS days
FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.earliest <= b.latest AND b.earliest <= a.latest AND a.earliest <= a.latest AND b.earliest <= b.latest GROUP BY 1""")
def orders_under_way(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a customer's orders that were under way at once, and for how many days."""
    r = _ranges(spark, d)
    pairs = intervals.overlap_join(r, r, ("earliest", "latest"), ("earliest", "latest"), ["o_custkey"]).where("left.o_orderkey < right.o_orderkey")
    days = F.datediff(F.least("left.latest", "right.latest"), F.greatest("left.earliest", "right.earliest"))
    return pairs.groupBy(F.col("left.o_custkey").alias("custkey")).agg(F.count("*").alias("pairs"), F.sum(days).alias("days"))


@query(f"""WITH {_RANGES}, p AS (SELECT *, lag(o_orderkey) OVER w AS parent, lag(earliest) OVER w AS p_earliest, lag(latest) OVER w AS p_latest FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT CASE WHEN p_earliest > latest THEN 'causal-time' ELSE 'causal-time-ambiguous' END AS code, CASE WHEN p_earliest > latest THEN 'error' ELSE 'warning' END AS severity, CAST(o_orderkey AS VARCHAR) AS subject, CAST(parent AS VARCHAR) AS detail
FROM p WHERE p_earliest > latest OR p_latest > earliest""")
def order_times(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders against the one numbered before: whether that can have come first."""
    placed = ranking.placed(_ranges(spark, d), ["o_custkey"], ["o_orderkey"])
    rows = ranking.before(placed, ["o_custkey"], "place", ["o_orderkey"])
    return validate.causal_time(rows.select(F.col("o_orderkey").alias("id"), "earliest", "latest", F.array_compact(F.array("before_o_orderkey")).alias("causal_parent_event_ids")))


# Segments with planted faults: some left out, some with a wrong digest, some twice, and texts that are gone.


@query(f"""WITH s AS ({ORACLES["paragraph_segments"]}), k AS (SELECT *, paragraph_index AS p, doc_id % 50 = 0 AS gone, paragraph_index % 7 = 3 AS cut FROM s)
SELECT 'segment-gap' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, start_char || '-' || end_char AS detail FROM k WHERE cut AND NOT gone
UNION ALL SELECT 'segment-digest', 'error', CAST(doc_id AS VARCHAR), CAST(p AS VARCHAR) FROM k WHERE NOT cut AND NOT gone AND p % 5 = 1
UNION ALL SELECT 'segment-overlap', 'error', CAST(doc_id AS VARCHAR), CAST(p AS VARCHAR) FROM k WHERE NOT cut AND NOT gone AND p % 11 = 9
UNION ALL SELECT 'segment-orphan', 'error', CAST(doc_id AS VARCHAR), CAST(p AS VARCHAR) FROM k WHERE NOT cut AND gone""")
def segment_faults(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs against their documents, with planted faults of each kind."""
    docs = table(spark, d, "documents")
    kept = corpus.segments(docs, "\n").where("paragraph_index % 7 <> 3").withColumnsRenamed({"doc_id": "unit", "paragraph_index": "name"})
    kept = kept.withColumn("text_digest", F.when(F.col("name") % 5 == 1, F.lit("sha256:other")).otherwise(F.col("text_digest")))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("name") % 11 == 9, 2).otherwise(1))))
    return cover.cover_findings(docs.where("doc_id % 50 <> 0").withColumnRenamed("doc_id", "unit"), kept)


# Orders as groups of choices, their lines as options that set the prices of parts: what lines and orders say of each other.

_CHOICES = """o AS (SELECT l_orderkey * 16 + l_linenumber AS id, l_orderkey AS g, l_linenumber AS k, l_partkey AS v, l_extendedprice AS x, l_returnflag = 'A' AS unlisted, l_discount >= 0.1 AS strays, l_tax > 0.07 AS twice FROM lineitem),
listed AS (SELECT g, id FROM o WHERE NOT unlisted), grp AS (SELECT o_orderkey AS g, count(id) AS n FROM orders LEFT JOIN listed ON g = o_orderkey GROUP BY 1)"""


@query(f"""WITH {_CHOICES}
SELECT code, subject, detail, count(*) AS n FROM (
SELECT 'duplicate-id' AS code, CAST(id AS VARCHAR) AS subject, count(*) || ' rows' AS detail FROM o GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate-id', CAST(g AS VARCHAR), CAST(id AS VARCHAR) FROM listed JOIN orders ON o_orderkey = g GROUP BY g, id HAVING count(*) > 1
UNION ALL SELECT 'variant-membership', CAST(id AS VARCHAR), CAST(g AS VARCHAR) FROM o JOIN orders ON o_orderkey = g WHERE id NOT IN (SELECT id FROM listed)
UNION ALL SELECT 'empty-variant-group', CAST(g AS VARCHAR), '' FROM grp WHERE n = 0
UNION ALL SELECT 'missing-reference', CAST(id AS VARCHAR), CAST(id + 1 AS VARCHAR) FROM o WHERE strays AND id + 1 NOT IN (SELECT id FROM o)
UNION ALL SELECT 'missing-reference', CAST(id AS VARCHAR), CAST(v AS VARCHAR) FROM (SELECT id, v, twice FROM o UNION ALL SELECT id, v, twice FROM o WHERE twice) WHERE v NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'duplicate-variable-override', CAST(id AS VARCHAR), CAST(v AS VARCHAR) FROM o WHERE twice
UNION ALL SELECT 'variable-bounds', CAST(id AS VARCHAR), CAST(v AS VARCHAR) FROM (SELECT id, v, x, twice FROM o UNION ALL SELECT id, v, x, twice FROM o WHERE twice) JOIN part ON p_partkey = v WHERE x < p_retailprice OR x > 40 * p_retailprice
UNION ALL SELECT 'variable-bounds', CAST(p_partkey AS VARCHAR), '' FROM part WHERE p_retailprice > 40 * p_retailprice) GROUP BY 1, 2, 3""")
def choice_findings(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a bible over orders, lines and parts."""
    line = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    own = F.struct(F.col("l_partkey").alias("variable_id"), F.col("l_extendedprice").alias("value"))
    empty = F.array().cast("array<bigint>")
    lines = table(spark, d, "lineitem")
    options = lines.select(
        line.alias("id"), F.col("l_orderkey").alias("group_id"), F.when(F.col("l_discount") >= 0.1, F.array(line + 1)).otherwise(empty).alias("requires_option_ids"),
        F.struct(F.when(F.col("l_tax") > 0.07, F.array(own, own)).otherwise(F.array(own)).alias("variable_overrides")).alias("effects"),
    )
    listed = lines.where("l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("option_ids"))
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("exactly-one").alias("cardinality")).join(listed, "id", "left")
    groups = groups.withColumn("option_ids", F.coalesce("option_ids", empty))
    price = F.col("p_retailprice")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), price.alias("initial_value"), price.alias("minimum"), (40 * price).alias("maximum"), F.lit(False).alias("integer"))
    found = validate.bible_findings({"variant_groups": groups, "variant_options": options, "state_variables": parts})
    return found.groupBy("code", "subject", "detail").agg(F.count("*").alias("n"))
