"""Research dossiers and answers: standings, next actions, coverage proofs, admission rules, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.fingerprint import SHA256
from tarnwick.operators.rules import finding, union


def standing(outcome: Column, authority: Column) -> Column:
    return (
        F.when(outcome == "reject-off-topic", "rejected")
        .when(outcome == "defer-insufficient-identity", "deferred")
        .when(authority == "discussion-provenance", "provenance-only")
        .when(authority == "scholarly-analogue", "constraint-only")
        .otherwise("supporting-only")
    )


#: What a gap of each kind asks for besides closing it (fixed values).
GAP_ACTIONS = {
    "private-source-missing": "search-private-edition", "public-record-missing": "acquire-public-record", "edition-unresolved": "resolve-edition", "locator-review-required": "review-exact-locator",
    "structured-review-required": "review-structured-observation", "disposition-rejected": "inspect-disposition", "disposition-deferred": "inspect-disposition", "recall-unreconciled": "reconcile-candidate", "continuity-conflict": "split-continuity",
}


def next_actions(continuities: Column, private: Column, unlocated: Column, structured: Column, disposed: Column, recalled: Column, gap_kinds: Column) -> Column:
    """Sorted distinct actions of a question, from counts and the kinds of its gaps."""
    parts = [
        F.when(continuities > 1, "split-continuity"), F.when(private == 0, "search-private-edition"), F.when(unlocated > 0, "review-exact-locator"), F.when(disposed > 0, "inspect-disposition"),
        F.when(structured == 0, "acquire-public-record"), F.when(recalled > 0, "reconcile-candidate"), F.when(F.size(gap_kinds) > 0, "close-gap"),
        *(F.when(F.array_contains(gap_kinds, k), a) for k, a in GAP_ACTIONS.items()),
    ]
    return F.array_sort(F.array_distinct(F.filter(F.array(*parts), lambda a: a.isNotNull())))


def standing_counts(*references: DataFrame) -> DataFrame:
    """(standing, n) over all kinds of references (standing)."""
    return union([r.select("standing") for r in references]).groupBy("standing").agg(F.count("*").alias("n"))


def coverage_findings(gaps: DataFrame, closed: DataFrame, limited: DataFrame, references: DataFrame, limited_references: DataFrame) -> DataFrame:
    """Every gap is closed or limited, and not both; every rejected or deferred reference is limited.

    gaps, closed and limited (gap_id); references (reference_id, standing); limited_references (reference_id).
    """
    c, li = closed.select("gap_id").distinct(), limited.select("gap_id").distinct()
    held = references.where("standing IN ('rejected', 'deferred')")
    return union(
        [
            finding(gaps.join(c.union(li), "gap_id", "left_anti"), "uncovered-gap", "error", F.col("gap_id")),
            finding(gaps.join(c, "gap_id", "left_semi").join(li, "gap_id", "left_semi"), "gap-both-closed-and-limited", "error", F.col("gap_id")),
            finding(held.join(limited_references, "reference_id", "left_anti"), "uncovered-disposition", "error", F.col("reference_id")),
        ]
    )


def render_answers(claims: DataFrame, limitations: DataFrame) -> DataFrame:
    """(answer_id, text): claims (answer_id, ord, text, source_id, locator_ids) in order with their citations, then limits (answer_id, ord, text)."""
    cites = F.array_join(F.transform("locator_ids", lambda i: F.concat(F.lit("["), F.col("source_id"), F.lit(":"), i, F.lit("]"))), " ")
    line = F.concat("text", F.when(cites != "", F.concat(F.lit(" "), cites)).otherwise(""))
    joined = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), sep)
    body = claims.select("answer_id", "ord", line.alias("line")).groupBy("answer_id").agg(joined("\n\n").alias("body"))
    ends = limitations.select("answer_id", "ord", F.concat(F.lit("- "), "text").alias("line")).groupBy("answer_id").agg(joined("\n").alias("limits"))
    out = body.join(ends, "answer_id", "left")
    return out.select("answer_id", F.concat("body", F.when(F.col("limits").isNotNull(), F.concat(F.lit("\n\nLimits:\n"), "limits")).otherwise("")).alias("text"))


Matrix = dict[str, tuple[str, tuple[str, ...]]]
#: outcome: (effect that evidence must have, reasons that go with it) (fixed values).
ADMISSION: Matrix = {
    "admit-to-review": ("supports-admission", ("exact-identity-and-question-match", "bounded-relevant-metadata")),
    "reject-off-topic": ("supports-rejection", ("off-topic-query-collision", "continuity-mismatch", "unsupported-question-lane")),
    "defer-insufficient-identity": ("unresolved", ("insufficient-work-identity", "insufficient-question-relevance")),
}


def admission_findings(admissions: DataFrame, matrix: Matrix = ADMISSION) -> DataFrame:
    """Findings of admissions (admission_id, outcome, reason, rationale, reviewed_by, reviewed_at, lanes, digests, evidence<effect, value, note>)."""
    i = F.col("admission_id")
    fits, effect = F.lit(False), F.lit(False)
    for outcome, (need, reasons) in matrix.items():
        fits = fits | ((F.col("outcome") == outcome) & F.col("reason").isin(list(reasons)))
        effect = effect | ((F.col("outcome") == outcome) & F.exists("evidence", _has_effect(need)))
    keys = F.transform("evidence", lambda e: F.struct(e["effect"], e["value"], e["note"]))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rule = lambda bad, code: finding(admissions.where(F.coalesce(bad, F.lit(True))), code, "error", i)
    return union(
        [
            rule(~F.forall("digests", lambda d: d.rlike(SHA256)), "admission-digest"),
            rule((F.size("lanes") == 0) | (F.size("lanes") != F.size(F.array_distinct("lanes"))) | F.exists("lanes", lambda x: blank(x)), "admission-question-lanes"),
            rule(F.size("evidence") == 0, "admission-evidence-empty"),
            rule(F.size(F.array_distinct(keys)) != F.size("evidence"), "admission-evidence-duplicate"),
            rule(F.exists("evidence", lambda e: blank(e["value"]) | blank(e["note"])), "admission-evidence-row"),
            rule(~fits, "admission-reason"),
            rule(~effect, "admission-evidence-effect"),
            rule(F.length(F.trim("rationale")) < 32, "admission-rationale"),
            rule(blank(F.col("reviewed_by")) | F.try_to_timestamp("reviewed_at").isNull(), "admission-reviewer"),
        ]
    )


def _has_effect(need: str):
    return lambda e: e["effect"] == need


def custody_time(admissions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Admissions reviewed before their receipt (request_id, completed_at) was complete."""
    j = admissions.join(receipts, "request_id").where(F.try_to_timestamp("reviewed_at") < F.try_to_timestamp("completed_at"))
    return finding(j, "reviewed-before-completed", "error", F.col("admission_id"), F.col("request_id").cast("string"))
