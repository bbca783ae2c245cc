"""The packaged review pipeline: intakes, transactions, projection plans and ledger postimages.

Every step is a gate: findings first, and rows go on only where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwick.functions.fingerprint import digest
from tarnwick.operators.rules import finding, union

#: Names that are nobody's (fixed values).
NOBODY = ("reviewer", "human", "user", "anonymous", "test")


def named_reviewer(name: Column) -> Column:
    """The name with single spaces, null if it is too short or nobody's."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((F.length(n) >= 3) & ~F.lower(n).isin(list(NOBODY)), n)


def split_candidates(records: DataFrame) -> DataFrame:
    """records (record_id, statement, parts): each part of a split record is a candidate, an unsplit record is one itself."""
    parts = F.when(F.size(F.coalesce("parts", F.array().cast("array<string>"))) > 0, F.col("parts")).otherwise(F.array("statement"))
    out = records.select("record_id", F.posexplode(parts).alias("part", "text"))
    return out.select(F.concat_ws("#", "record_id", (F.col("part") + 1).cast("string")).alias("candidate_id"), "record_id", "part", "text", digest(F.col("text")).alias("digest"))


def batches(candidates: DataFrame, n: int, order: str = "candidate_id", group: str | None = None) -> DataFrame:
    """Candidates in n batches of equal size, in order, within each group."""
    w = W.partitionBy(group) if group else W.partitionBy(F.lit(0))
    return candidates.withColumn("batch", F.ntile(n).over(w.orderBy(order)))


def intake_findings(intakes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Findings of intakes (intake_id, candidate_id, reviewer, actor, action, digest)."""
    bound = intakes.join(candidates.select("candidate_id", F.col("digest").alias("_d")), "candidate_id", "left")
    return union(
        [
            finding(bound.where("_d IS NULL"), "unknown-candidate", "error", F.col("intake_id")),
            finding(bound.where("_d <> digest"), "digest-drift", "error", F.col("intake_id")),
            finding(bound.where(named_reviewer(F.col("reviewer")).isNull()), "unnamed-reviewer", "error", F.col("intake_id")),
            finding(bound.where(F.lower(F.trim("actor")) == F.lower(F.trim("reviewer"))), "actor-is-reviewer", "error", F.col("intake_id")),
            finding(bound.where(~F.col("action").isin("confirm", "correct", "split", "merge", "reject", "defer")), "unknown-action", "error", F.col("intake_id")),
        ]
    )


def stage(intakes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sealed transactions of the intakes that have no finding."""
    bad = intake_findings(intakes, candidates).where("severity = 'error'").select(F.col("subject").alias("_i")).distinct()
    ok = intakes.join(bad, F.col("intake_id").cast("string") == F.col("_i"), "left_anti")
    return ok.withColumn("seal", digest(F.to_json(F.struct("action", "candidate_id", "digest", "intake_id", "reviewer"))))


#: What an action drafts: (kind, needs a statement) (fixed values).
DRAFTS = {"confirm": ("proposition", "evidence-edge"), "correct": ("proposition", "evidence-edge"), "split": ("proposition", "evidence-edge"), "reject": ("disposition",), "defer": ("review-hold",), "merge": ("merge-hold",)}


def projection_plan(transactions: DataFrame) -> DataFrame:
    """(candidate_id, action, draft, draft_id) of transactions; nothing is executed."""
    kinds = F.lit(None).cast("array<string>")
    for action, drafts in DRAFTS.items():
        kinds = F.when(F.col("action") == action, F.array(*map(F.lit, drafts))).otherwise(kinds)
    out = transactions.select("candidate_id", "action", "seal", F.explode(kinds).alias("draft"))
    return out.select("candidate_id", "action", "draft", F.concat("draft", F.lit(":"), F.substring(F.sha2(F.concat_ws("|", "seal", "draft"), 256), 1, 32)).alias("draft_id"))


def postimage(ledger: DataFrame, plan: DataFrame, key: str = "draft_id") -> DataFrame:
    """The ledger as it would be: its rows and those of the plan that it has not."""
    return ledger.unionByName(plan.join(ledger.select(key), key, "left_anti"))


def inspect(files: DataFrame, length: int, sha256: str) -> DataFrame:
    """(path, decision) of files (path, length, sha256), the first reason that applies."""
    decision = F.when(F.col("length") == 0, "reject-empty").when(F.col("length") != length, "reject-length").when(F.col("sha256") != sha256, "reject-digest").otherwise("accept")
    return files.select("path", decision.alias("decision"))
