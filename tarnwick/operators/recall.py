"""Candidates: multi-predicate queries, the estate manifest, work orders and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.fingerprint import fnv1a32, ratio_permille
from tarnwick.operators import graph
from tarnwick.session import materialise

#: Domains that establish base vocabulary or state (fixed values).
FOUNDATIONAL = ("core-entities", "lineage-claims", "chronology-geography", "actor-knowledge")


def query(
    candidates: DataFrame,
    domains: Sequence[str] | None = None,
    kinds: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    hints: Sequence[str] | None = None,
    least: int | None = None,
    text: str | None = None,
) -> DataFrame:
    """Candidates that all given conditions hold for, by id; a condition that is None is not one."""
    out = candidates
    overlap = lambda c, values: F.arrays_overlap(c, F.array(*map(F.lit, values)).cast("array<string>"))
    if domains is not None:
        out = out.where(F.col("domain").isin(list(domains)))
    if kinds is not None:
        out = out.where(F.col("kind").isin(list(kinds)))
    if tags is not None:
        out = out.where(overlap("tags", tags))
    if hints is not None:
        out = out.where(overlap("source_hints", hints))
    if least is not None:
        out = out.where(F.col("confidence_permille") >= least)
    if text and text.strip():
        hay = F.concat_ws("\n", "id", "label", "summary", "reconciliation_keys", "tags")
        out = out.where(F.lower(hay).contains(text.strip().lower()))
    return out.orderBy("id")


def zero_filled(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """(key, n) for every row of the dimension, 0 where there is none."""
    n = df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
    return keys.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bands(value: Column) -> list[Column]:
    return [
        F.count_if(value >= 850).alias("high"),
        F.count_if((value >= 600) & (value < 850)).alias("medium"),
        F.count_if(value < 600).alias("low"),
    ]


def manifest(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.countDistinct("packet_id").alias("packets"), F.count("*").alias("candidates"), *bands(F.col("confidence_permille")))


def priority(direct: Column, foundational: Column, leverage: Column, disputed: Column, confidence: Column) -> Column:
    """1000 or 500, and 300, 200, 150 for what applies, and a tenth of the confidence."""
    return (
        F.when(direct, 1000).otherwise(500) + F.when(foundational, 300).otherwise(0) + F.when(leverage, 200).otherwise(0) + F.when(disputed, 150).otherwise(0) + F.floor(confidence / 10)
    ).cast("long")


def lanes(direct: Column, foundational: Column, leverage: Column, disputed: Column) -> Column:
    parts = [F.when(direct, "direct-source").otherwise("cross-source-context"), F.when(foundational, "foundational"), F.when(leverage, "high-leverage"), F.when(disputed, "disputed")]
    return F.array_sort(F.filter(F.array(*parts), lambda x: x.isNotNull()))


def cluster_rollup(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per cluster: members, keys, domains, hints, the least confidence, and its id."""
    c = candidates.join(assigned, candidates["id"] == assigned["node"]).groupBy("component").agg(
        F.array_sort(F.collect_set("id")).alias("candidate_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reconciliation_keys")))).alias("keys"),
        F.array_sort(F.collect_set("domain")).alias("domains"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_hints")))).alias("hints"),
        F.min("confidence_permille").alias("confidence_floor"),
    )
    core = F.to_json(F.struct(F.col("candidate_ids").alias("candidateIds"), F.col("keys").alias("reconciliationKeys")))
    return c.withColumn("cluster_id", F.concat(F.lit("cluster-"), "component", F.lit("-"), F.substring(fnv1a32(core), 9, 8)))


def work_order(candidates: DataFrame, hints: Sequence[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """(items, clusters): candidates with a requested hint, those within `depth` shared keys, and their clusters."""
    wanted = F.array(*map(F.lit, hints)).cast("array<string>")
    direct = candidates.where(F.arrays_overlap("source_hints", wanted)).select(F.col("id").alias("node"))
    members = candidates.select(F.col("id").alias("node"), F.explode("reconciliation_keys").alias("key"))
    reach = graph.bounded_bfs(members, direct, depth)
    chosen = candidates.join(reach.select(F.col("node").alias("id"), "depth"), "id")
    own = members.join(reach.select("node"), "node", "left_semi")
    linked = graph.clusters(own)
    alone = reach.select("node").join(linked.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    assigned = materialise(linked.unionByName(alone), "assigned")
    clusters = cluster_rollup(chosen, assigned)
    # Members are counted, one row a node: a cluster's ids stand in its own row and in no item's.
    size = assigned.groupBy("component").agg(F.count("*").alias("members"))
    of = clusters.select("component", "cluster_id", F.size("domains").alias("n_domains"), F.size("hints").alias("n_hints")).join(size, "component")
    is_direct, base = F.col("depth") == 0, F.col("domain").isin(list(FOUNDATIONAL))
    leverage = (F.col("members") >= 3) | (F.col("n_domains") >= 2) | (F.col("n_hints") >= 3)
    disputed = (F.col("kind") == "question") | (F.col("confidence_permille") < 600)
    items = chosen.join(assigned.withColumnRenamed("node", "id"), "id").join(of, "component").select(
        F.col("id").alias("candidate_id"), "cluster_id", lanes(is_direct, base, leverage, disputed).alias("lanes"), priority(is_direct, base, leverage, disputed, F.col("confidence_permille")).alias("priority")
    )
    return items.orderBy(F.desc("priority"), "candidate_id"), clusters


# Reconciliation.


def merge_in_one_cluster(decisions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Decisions (decision_id, candidate_id) all of whose candidates are in one cluster (cluster_id, candidate_id)."""
    # each pair once on either side: then plain counts do, and rows are summed before they are shuffled
    asked = decisions.select("decision_id", "candidate_id").distinct()
    held = clusters.select("cluster_id", "candidate_id").distinct()
    size = asked.groupBy("decision_id").agg(F.count("*").alias("of"))
    met = asked.join(held, "candidate_id").groupBy("decision_id", "cluster_id").agg(F.count("*").alias("met"))
    return met.join(size, "decision_id").where("met = of").select("decision_id", "cluster_id")


ACTIONS = ("confirm", "correct", "split", "merge", "reject", "defer")


def reconcile(work: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: coverage, and candidates by action; all 0 if there is any error.

    work (candidate_id), decisions (decision_id, action, candidate_id).
    """
    by = decisions.join(work, "candidate_id", "left_semi").select("action", "candidate_id").distinct()
    total = work.select("candidate_id").distinct().agg(F.count("*").alias("total"))
    done = by.agg(
        F.countDistinct("candidate_id").alias("reviewed"),
        F.countDistinct(F.when(F.col("action") != "defer", F.col("candidate_id"))).alias("resolved"),
        *(F.count_if(F.col("action") == a).alias(a) for a in ACTIONS),
    )
    errors = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"))
    # each side of these joins is a single row
    one = done.join(F.broadcast(total)).join(F.broadcast(errors))
    ok = F.col("errors") == 0
    gated = {"reviewed": F.col("reviewed"), "coverage_permille": ratio_permille(F.col("reviewed"), F.col("total")), "resolved_permille": ratio_permille(F.col("resolved"), F.col("total")), **{a: F.col(a) for a in ACTIONS}}
    return one.select(ok.alias("passed"), "total", *(F.when(ok, c).otherwise(0).alias(n) for n, c in gated.items()))


def reconciled(work: DataFrame, decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """(action, candidate_id) of the reviewed candidates; none if there is any error."""
    by = decisions.join(work, "candidate_id", "left_semi").select("action", "candidate_id").distinct()
    errors = findings.where("severity = 'error'").select(F.lit(1).alias("one")).limit(1)
    return by.withColumn("one", F.lit(1)).join(F.broadcast(errors), "one", "left_anti").drop("one")


#: action: (least and most candidates, of evidence, of promoted records) (fixed values).
SHAPES = {
    "confirm": ((1, 1), (1, None), (1, 1)),
    "correct": ((1, 1), (1, None), (1, 1)),
    "split": ((1, 1), (2, None), (2, None)),
    "merge": ((2, None), (1, None), (1, 1)),
    "reject": ((1, None), (1, None), (0, 0)),
    "defer": ((1, None), (0, 0), (0, 0)),
}


def action_shape(decisions: DataFrame) -> DataFrame:
    """Findings for decisions (decision_id, action, candidate_ids, evidence_ids, promoted_ids) of the wrong shape."""
    from tarnwick.operators.rules import finding

    bad = ~F.col("action").isin(list(SHAPES))
    for action, bounds in SHAPES.items():
        wrong = F.lit(False)
        for column, (low, high) in zip(("candidate_ids", "evidence_ids", "promoted_ids"), bounds, strict=True):
            wrong = wrong | (F.size(column) < low)
            if high is not None:
                wrong = wrong | (F.size(column) > high)
        bad = bad | ((F.col("action") == action) & wrong)
    return finding(decisions.where(bad), "action-shape", "error", F.col("decision_id"), F.col("action"))


def twice_decided(decisions: DataFrame) -> DataFrame:
    from tarnwick.operators.rules import finding

    d = decisions.groupBy("candidate_id").agg(F.countDistinct("decision_id").alias("n")).where("n > 1")
    return finding(d, "candidate-decided-twice", "error", F.col("candidate_id"))


def classify(coverage: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal_id, classification) from coverage (proposal_id, key) and proposals (proposal_id, contradicted)."""
    ok = coverage.join(proposals.where("NOT contradicted"), "proposal_id", "left_semi").distinct()
    n = ok.groupBy("key").agg(F.count("*").alias("n"))
    per = ok.join(n, "key").groupBy("proposal_id").agg(F.min("n").alias("least"))
    kind = F.when(F.col("contradicted"), "contradicted").when(F.col("least") == 1, "necessary").when(F.col("least") > 1, "strongly-implied").otherwise("permissible")
    return proposals.join(per, "proposal_id", "left").select("proposal_id", kind.alias("classification"))
