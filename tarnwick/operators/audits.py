"""Audits of whole estates held as tables: recall packets, evidence bundles, review decisions, collector estates,
research questions with their references, and reviewed answers.

All rules about the rows of one table are one pass over it: an array of those that fail, exploded. References are
left joins that mark what was not found, so a rule about another table's row is a condition like any other. Findings
are (code, severity, subject, detail). A null field fails what asks for a value; arrays may be null and count as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.fingerprint import SHA256
from tarnwick.functions.text import safe_relative
from tarnwick.operators.rules import count_drift, duplicates, exactly_one, finding, missing_reference, union

#: (code, what is wrong[, severity])
Rules = Sequence[tuple]


def row_rules(rows: DataFrame, subject: str, rules: Rules) -> DataFrame:
    """The findings of rows by rules; a condition that is null is none."""
    failed = [F.when(F.coalesce(r[1], F.lit(False)), F.struct(F.lit(r[0]).alias("code"), F.lit(r[2] if len(r) > 2 else "error").alias("severity"))) for r in rules]
    each = rows.select(F.col(subject).cast("string").alias("subject"), F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("f"))
    return each.select("f.code", "f.severity", "subject", F.lit("").alias("detail"))


def blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))) == ""


def size(c: str) -> Column:
    return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))


def repeats(c: str) -> Column:
    return size(c) != F.size(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def no_digest(c: str | Column) -> Column:
    return ~F.coalesce((c if isinstance(c, Column) else F.col(c)).rlike(SHA256), F.lit(False))


def differs(a: str | Column, b: str | Column) -> Column:
    one, two = (x if isinstance(x, Column) else F.col(x) for x in (a, b))
    return ~one.eqNullSafe(two)


def no_time(c: str) -> Column:
    return F.try_to_timestamp(F.col(c)).isNull()


def effects(*columns: str) -> Column:
    """Whether something took an effect that it must not have: each column says `none`."""
    out = F.lit(False)
    for c in columns:
        out = out | differs(c, F.lit("none"))
    return out


def _marked(table: DataFrame, key: str, mark: str, *columns: str) -> DataFrame:
    """One row for each key with a mark, to be joined from the left; further columns get the mark as a prefix."""
    return table.groupBy(F.col(key).alias(f"{mark}_id")).agg(F.lit(True).alias(f"{mark}_is"), *(F.first(c).alias(f"{mark}_{c}") for c in columns))


def attach(rows: DataFrame, ref: str, table: DataFrame, key: str, mark: str, *columns: str) -> DataFrame:
    return rows.join(_marked(table, key, mark, *columns), F.col(ref) == F.col(f"{mark}_id"), "left")


def absent(mark: str) -> Column:
    return F.col(f"{mark}_is").isNull()


# Recall packets (fixed values).

FORBIDDEN_KEYS = ("authorityTier", "canonical", "contentDigest", "locatorIds", "quote", "quotedText", "sourceDigest", "verbatim")
GENERATORS = ("language-model-recall", "conversation-synthesis")


def recall_findings(packets: DataFrame, candidates: DataFrame, hints: DataFrame, form: str) -> DataFrame:
    """packets (id, format, generated_by, authority, compilation_eligible, knowledge_cutoff, universe_id, scope), candidates
    (packet_id, id, label, summary, confidence_permille, source_hints, continuity_hints, reconciliation_keys, normalized: map),
    hints (id); form is the format of packets."""
    conf = F.col("confidence_permille")
    own = row_rules(packets, "id", [
        ("invalid-format", differs("format", F.lit(form))),
        ("invalid-generator", ~F.coalesce(F.col("generated_by").isin(list(GENERATORS)), F.lit(False))),
        ("recall-claims-authority", differs("authority", F.lit("none"))),
        ("recall-claims-compilation-standing", differs("compilation_eligible", F.lit(False))),
        ("invalid-knowledge-cutoff", ~F.coalesce(F.col("knowledge_cutoff").rlike(r"^\d{4}-\d{2}$"), F.lit(False))),
        ("missing-universe", blank("universe_id")),
        ("missing-scope", blank("scope")),
    ])
    each = row_rules(candidates, "id", [
        ("missing-id", blank("id")),
        ("missing-label", blank("label")),
        ("missing-summary", blank("summary")),
        ("invalid-confidence", conf.isNull() | (conf < 0) | (conf > 1000) | (conf != F.floor(conf))),
        ("missing-source-hint", size("source_hints") == 0),
        ("missing-continuity-hint", size("continuity_hints") == 0),
        ("missing-reconciliation-key", size("reconciliation_keys") == 0),
        ("recall-claims-source-standing", F.arrays_overlap(F.map_keys("normalized"), F.lit(list(FORBIDDEN_KEYS)))),
        ("raw-url-source-hint", F.exists("source_hints", lambda h: h.rlike(r"(?i)^https?://"))),
    ])
    twice = candidates.groupBy("packet_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("id").distinct()
    return union([
        own, each, finding(twice, "duplicate-candidate-id", "error", F.col("id")), duplicates(packets, "id", "duplicate-packet-id"), duplicates(candidates, "id", "duplicate-estate-candidate-id"),
        duplicates(hints, "id", "duplicate-source-hint-id"), missing_reference(candidates, "id", "source_hints", hints, "id", "unknown-source-hint"),
    ])


# Evidence bundles and review decisions.


def evidence_findings(bundles: DataFrame, sources: DataFrame, locators: DataFrame, records: DataFrame, form: str) -> DataFrame:
    """bundles (id, format, universe_id), sources (bundle_id, id, title, version, universe_id, continuity_id, source_hint_ids, digest,
    file_size_bytes), locators (id, source_id, unit, start, end, content_digest), records (id, source_id, label, continuity_id,
    locator_ids, reconciliation_keys, review_status, reviewed_by)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf")) & (c >= 0)
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    with_bundle = attach(sources, "bundle_id", bundles, "id", "b", "universe_id")
    with_source = attach(records, "source_id", sources, "id", "s", "continuity_id")
    cited = records.select("id", "source_id", F.explode("locator_ids").alias("locator_id"))
    cited = attach(cited, "locator_id", locators, "id", "l", "source_id")
    reviewed, extracted = F.col("review_status") == "reviewed", F.col("review_status") == "machine-extracted"
    filled = bundles.join(_marked(sources, "bundle_id", "s"), F.col("id") == F.col("s_id"), "left")
    return union([
        row_rules(filled, "id", [
            ("evidence-format", differs("format", F.lit(form))),
            ("missing-id", blank("id")),
            ("missing-universe", blank("universe_id")),
            ("empty-evidence-bundle", absent("s"), "warning"),
        ]),
        duplicates(sources, "id", "duplicate-source"), duplicates(locators, "id", "duplicate-locator"), duplicates(records, "id", "duplicate-evidence-record"),
        row_rules(with_bundle, "id", [
            ("incomplete-source", blank("id") | blank("title") | blank("version")),
            ("source-universe-mismatch", differs("universe_id", "b_universe_id")),
            ("missing-continuity", blank("continuity_id")),
            ("missing-source-hint", size("source_hint_ids") == 0),
            ("invalid-sha256", no_digest("digest")),
            ("invalid-file-size", F.col("file_size_bytes").isNull() | (F.col("file_size_bytes") <= 0) | (F.col("file_size_bytes") != F.floor("file_size_bytes"))),
        ]),
        row_rules(attach(locators, "source_id", sources, "id", "s"), "id", [
            ("unknown-locator-source", absent("s")),
            ("missing-locator-unit", blank("unit")),
            ("invalid-locator-range", ~finite(start)), ("invalid-locator-range", ~finite(end)), ("invalid-locator-range", start > end),
            ("invalid-sha256", F.col("content_digest").isNotNull() & no_digest("content_digest")),
        ]),
        row_rules(with_source, "id", [
            ("unknown-record-source", absent("s")),
            ("incomplete-evidence-record", blank("id") | blank("label")),
            ("missing-continuity", blank("continuity_id")),
            ("record-continuity-mismatch", ~absent("s") & differs("continuity_id", "s_continuity_id")),
            ("missing-record-locator", size("locator_ids") == 0),
            ("duplicate-record-locator", repeats("locator_ids")),
            ("missing-reconciliation-key", size("reconciliation_keys") == 0),
            ("missing-evidence-reviewer", reviewed & blank("reviewed_by")),
            ("premature-reviewer", extracted & ~blank("reviewed_by"), "warning"),
        ]),
        row_rules(cited, "id", [("unknown-record-locator", absent("l")), ("cross-source-locator", ~absent("l") & differs("l_source_id", "source_id"))]),
    ])


def decision_set_findings(sets: DataFrame, orders: DataFrame, bundles: DataFrame, work: DataFrame, candidates: DataFrame, records: DataFrame, decisions: DataFrame, form: str) -> DataFrame:
    """sets (id, format, reviewer_id, work_order_id, work_order_fingerprint, evidence_bundle_id, evidence_bundle_fingerprint), orders and
    bundles (id, fingerprint), work (work_order_id, candidate_id, cluster_id), candidates and records (id, reconciliation_keys; records also
    review_status, reviewed_by), decisions (set_id, id, action, candidate_ids, evidence_ids, promoted_ids, rationale)."""
    from tarnwick.operators.recall import SHAPES

    bound = attach(attach(sets, "work_order_id", orders, "id", "o", "fingerprint"), "evidence_bundle_id", bundles, "id", "e", "fingerprint")
    shapes = []
    for action, limits in SHAPES.items():
        wrong = F.lit(False)
        for column, (low, high) in zip(("candidate_ids", "evidence_ids", "promoted_ids"), limits, strict=True):
            wrong = wrong | (size(column) < low)
            wrong = wrong | (size(column) > high) if high is not None else wrong
        shapes.append((f"invalid-{action}-shape", (F.col("action") == action) & wrong))
    asked = decisions.select("id", "action", "set_id", F.explode("candidate_ids").alias("candidate_id"))
    cites = decisions.select("id", "action", F.explode("evidence_ids").alias("record_id"))
    cites = attach(cites, "record_id", records, "id", "r")
    promoted = decisions.select("id", "action", "evidence_ids", F.explode("promoted_ids").alias("record_id"))
    promoted = attach(promoted, "record_id", records, "id", "r", "review_status", "reviewed_by", "reconciliation_keys")
    keeps = F.col("action").isin("confirm", "correct", "split", "merge")
    # all of a decision's candidates and promoted records, by their keys, once for each decision
    known = promoted.where(keeps & ~absent("r")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("r_reconciliation_keys"))).alias("keys"))
    pairs = attach(asked.where(keeps), "candidate_id", candidates, "id", "c", "reconciliation_keys").join(known, "id")
    usable = cites.groupBy("id", "action").agg(F.count_if(~absent("r")).alias("n")).where("n = 0 AND action <> 'defer'")
    merges = asked.where("action = 'merge'").select("id", "candidate_id").distinct()
    of = merges.groupBy("id").agg(F.count("*").alias("of"))
    whole = merges.join(work.select("candidate_id", "cluster_id").distinct(), "candidate_id").groupBy("id", "cluster_id").agg(F.count("*").alias("n")).join(of, "id").where("n = of")
    pending = work.join(asked.select("candidate_id").distinct(), "candidate_id", "left_anti").groupBy("work_order_id").agg(F.count("*").alias("n"))
    double = asked.select("id", "candidate_id").distinct().groupBy("candidate_id").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    again = asked.select("id", "candidate_id").distinct().join(double, "candidate_id").where("id <> first")
    return union([
        row_rules(bound, "id", [
            ("decision-format", differs("format", F.lit(form))),
            ("incomplete-decision-set", blank("id") | blank("reviewer_id")),
            ("work-order-id-mismatch", absent("o")),
            ("work-order-fingerprint-mismatch", differs("work_order_fingerprint", "o_fingerprint")),
            ("evidence-bundle-mismatch", absent("e") | differs("evidence_bundle_fingerprint", "e_fingerprint")),
        ]),
        duplicates(decisions, "id", "duplicate-decision"),
        row_rules(decisions, "id", [
            *shapes,
            ("missing-rationale", blank("rationale")),
            ("missing-candidate", size("candidate_ids") == 0),
            ("duplicate-decision-candidate", repeats("candidate_ids")),
            ("duplicate-decision-record", repeats("evidence_ids") | repeats("promoted_ids")),
        ]),
        missing_reference(work, "candidate_id", "candidate_id", candidates, "id", "missing-recall-candidate"),
        row_rules(attach(asked, "candidate_id", work, "candidate_id", "w"), "id", [("candidate-outside-work-order", absent("w"))]),
        finding(again, "candidate-double-decision", "error", F.col("id"), F.col("candidate_id").cast("string")),
        row_rules(cites, "id", [("unknown-evidence-record", absent("r"))]),
        row_rules(promoted, "id", [
            ("promotion-without-evidence", ~F.array_contains("evidence_ids", F.col("record_id"))),
            ("unreviewed-promotion", ~absent("r") & differs("r_review_status", F.lit("reviewed"))),
            ("missing-evidence-reviewer", keeps & (F.col("r_review_status") == "reviewed") & blank("r_reviewed_by")),
        ]),
        finding(of.join(whole, "id", "left_anti"), "cross-cluster-merge", "error", F.col("id")),
        row_rules(pairs, "id", [("reconciliation-key-mismatch", ~absent("c") & ~F.arrays_overlap("c_reconciliation_keys", "keys"))]),
        finding(usable, "missing-usable-evidence", "error", F.col("id")),
        finding(sets.join(pending, "work_order_id"), "pending-review", "notice", F.col("id"), F.col("n").cast("string")),
    ])


# Collector estates.

#: Rights under which a retained observation has to carry public credit, and under which bodies may be kept (fixed values).
CREDIT_LICENSES = ("cc-by", "cc-by-sa")


def estate_findings(t: dict[str, DataFrame]) -> DataFrame:
    """Tables: atlas (id, rights, body_allowed), ledger (source_id, graph_effect, canon_effect, observation_count, candidate_count, gap_count,
    attempt_count, credit_count), observations (id, source_id, retention, has_credit, receipt_uri, content_digest), candidates (id, source_id,
    observation_ids, promotion_status, graph_effect, canon_effect), cache (key, source_id, observation_id, content_digest, uri), files (uri),
    credits (observation_id, source_id), gaps and attempts (source_id; attempts also id, receipt_uri), routes (id, source_id, graph_effect,
    canon_effect, route_digest, robots_digest, terms_digest)."""
    needs = F.coalesce(F.lower("a_rights").isin(list(CREDIT_LICENSES)), F.lit(False))
    atlas = lambda df: attach(df, "source_id", t["atlas"], "id", "a", "rights", "body_allowed")
    file = lambda df, uri: attach(df, uri, t["files"], "uri", "f")
    seen = lambda df: attach(df, "observation_id", t["observations"], "id", "o", "source_id", "content_digest")
    unsafe = lambda c: ~F.coalesce(safe_relative(F.col(c)), F.lit(False))
    ledger, observed = atlas(t["ledger"]), atlas(file(t["observations"], "receipt_uri"))
    credited = attach(observed, "id", t["credits"], "observation_id", "c")
    parts = [
        row_rules(ledger, "source_id", [("unknown-source-ledger-row", absent("a")), ("source-ledger-authority-leak", effects("graph_effect", "canon_effect"))]),
        duplicates(t["ledger"], "source_id", "duplicate-source-ledger-row"),
        missing_reference(t["atlas"], "id", "id", t["ledger"], "source_id", "missing-source-ledger-row"),
        row_rules(credited, "id", [
            ("observation-unknown-source", absent("a")),
            ("body-retention-rights-mismatch", (F.col("retention") == "licensed-structured-body") & ~absent("a") & ~F.coalesce("a_body_allowed", F.lit(False))),
            ("missing-observation-credit", needs & ~F.col("has_credit")),
            ("unnecessary-observation-credit", ~absent("a") & ~needs & F.col("has_credit"), "warning"),
            ("missing-observation-receipt", ~absent("a") & (unsafe("receipt_uri") | absent("f"))),
            ("missing-public-credit", needs & absent("c")),
        ]),
        row_rules(t["candidates"], "id", [("candidate-authority-leak", effects("graph_effect", "canon_effect")), ("collector-promotion-leak", differs("promotion_status", F.lit("intake-only")))]),
        missing_reference(t["candidates"], "id", "observation_ids", t["observations"], "id", "candidate-missing-observation"),
        row_rules(file(seen(t["cache"]), "uri"), "key", [
            ("cache-missing-observation", absent("o")),
            ("cache-source-mismatch", ~absent("o") & differs("o_source_id", "source_id")),
            ("cache-digest-mismatch", ~absent("o") & differs("o_content_digest", "content_digest")),
            ("unsafe-cache-path", F.col("uri").isNotNull() & unsafe("uri")),
            ("missing-cache-file", ~unsafe("uri") & absent("f")),
        ]),
        finding(t["files"].where("uri LIKE 'cache/%'").join(t["cache"].select("uri"), "uri", "left_anti"), "orphan-cache-file", "warning", F.col("uri")),
        duplicates(t["credits"], "observation_id", "duplicate-public-credit"),
        row_rules(atlas(seen(t["credits"])), "observation_id", [
            ("credit-missing-observation", absent("o")), ("public-credit-overreach", absent("a") | ~needs), ("credit-source-mismatch", ~absent("o") & differs("o_source_id", "source_id")),
        ]),
        row_rules(file(t["attempts"], "receipt_uri"), "id", [("missing-attempt-receipt", F.col("receipt_uri").isNotNull() & (unsafe("receipt_uri") | absent("f")))]),
        row_rules(atlas(t["routes"]), "id", [
            ("health-observation-unknown-source", absent("a")), ("health-observation-authority-leak", effects("graph_effect", "canon_effect")),
            ("health-observation-digest", no_digest("route_digest") | no_digest("robots_digest") | no_digest("terms_digest")),
        ]),
    ]
    n = t["ledger"].agg(F.count("*").alias("n")).join(F.broadcast(t["atlas"].agg(F.count("*").alias("of"))))  # both are one row
    parts.append(finding(n.where("n <> of"), "source-ledger-count", "error", F.lit("ledger"), F.concat_ws("/", F.col("n").cast("string"), F.col("of").cast("string"))))
    said = t["ledger"].dropDuplicates(["source_id"])
    for kind in ("observation", "candidate", "gap", "attempt", "credit"):
        rows = t[f"{kind}s"].join(said.select("source_id"), "source_id", "left_semi")
        parts.append(count_drift(said, rows, "source_id", f"{kind}_count", f"{kind}-count-drift"))
    return union(parts)


# Research questions with their references.


def question_findings(t: dict[str, DataFrame], forms: dict[str, str]) -> DataFrame:
    """Tables: lanes (id, policy), sources (id, mode, continuity_ids, lane_ids), recall (id, packet_id, generated_by, continuity_hints), questions (id, format,
    digest, created_by, created_at, lane_ids, continuity_ids, reason, analogue, text_retained, authority, graph_effect, canon_effect, answer_effect,
    route_format, route_lane_ids), private (id, question_id, source_id, continuity_id, edition_key, unit_id, paragraph_id, locator, paragraph_digest,
    snippet_digest, snippet_characters, text_retained, standing, graph_effect, canon_effect), structured (id, question_id, source_id, continuity_id,
    admission_format, admission_source_id, receipt_format, receipt_source_id, lane_ids, standing, expected_standing, outcome, authority_role, raw_retained,
    graph_effect, canon_effect), recalled (id, question_id, candidate_id, packet_id, generated_by, continuity_id, authority, standing, graph_effect,
    canon_effect), gaps (id, question_id, lane_id, continuity_id, detail, source_id, candidate_id, standing, graph_effect, canon_effect)."""
    strings = F.array().cast("array<string>")
    unsorted = lambda c: (size(c) == 0) | ~F.array_sort(F.array_distinct(F.coalesce(c, strings))).eqNullSafe(F.col(c))
    lanes = t["questions"].select(F.col("id").alias("q"), F.explode("lane_ids").alias("lane"))
    lanes = attach(lanes, "lane", t["lanes"], "id", "l", "policy").groupBy("q").agg(
        F.count_if(absent("l")).alias("unknown"), F.count_if(F.col("l_policy") == "same-continuity-required").alias("same"), F.count_if(F.col("l_policy") == "analogue-only").alias("analogues")
    )
    q = t["questions"].join(lanes, F.col("id") == F.col("q"), "left")
    many = size("continuity_ids") > 1
    of = lambda df: attach(df, "question_id", t["questions"], "id", "q", "continuity_ids", "lane_ids")
    source = lambda df: attach(df, "source_id", t["sources"], "id", "s", "mode", "continuity_ids", "lane_ids")
    outside = ~F.coalesce(F.array_contains("q_continuity_ids", F.col("continuity_id")), F.lit(False))
    foreign = ~absent("s") & ~F.coalesce(F.array_contains("s_continuity_ids", F.col("continuity_id")), F.lit(False))
    unrouted = ~absent("s") & ~F.coalesce(F.arrays_overlap("s_lane_ids", "q_lane_ids"), F.lit(False))
    idle = differs("standing", F.lit("navigation-only")) | effects("graph_effect", "canon_effect")
    parts = [
        row_rules(q, "id", [
            ("question-format", differs("format", F.lit(forms["question"]))),
            ("question-digest", no_digest("digest")),
            ("question-creator", blank("created_by") | no_time("created_at")),
            ("question-lanes", unsorted("lane_ids") | (F.coalesce("unknown", F.lit(0)) > 0)),
            ("question-continuities", unsorted("continuity_ids")),
            ("question-continuity-mix", many & (F.coalesce("same", F.lit(0)) > 0)),
            ("question-cross-continuity-reason", many & blank("reason")),
            ("question-analogue-continuity", (F.coalesce("analogues", F.lit(0)) > 0) & ~F.coalesce("analogue", F.lit(False))),
            ("question-authority", differs("text_retained", F.lit(False)) | effects("authority", "graph_effect", "canon_effect", "answer_effect")),
            ("route-format", differs("route_format", F.lit(forms["route"]))),
            ("route-lane-parity", differs("route_lane_ids", "lane_ids")),
        ]),
        row_rules(source(of(t["private"])), "id", [
            ("private-source", absent("s") | differs("s_mode", F.lit("local-private-only"))),
            ("private-continuity", outside), ("private-source-continuity", foreign),
            ("private-custody", blank("edition_key") | blank("unit_id") | blank("paragraph_id") | blank("locator") | F.col("locator").contains("..") | F.col("locator").contains("\\") | no_digest("paragraph_digest")),
            ("private-snippet-digest", F.col("snippet_digest").isNotNull() & no_digest("snippet_digest")),
            ("private-snippet-size", (F.col("snippet_characters") < 1) | (F.col("snippet_characters") > 2000)),
            ("private-authority", differs("text_retained", F.lit(False)) | idle),
            ("private-lane", unrouted, "warning"),
        ]),
        row_rules(source(of(t["structured"])), "id", [
            ("structured-source", absent("s")), ("structured-continuity", outside), ("structured-source-continuity", foreign),
            ("structured-admission-format", differs("admission_format", F.lit(forms["admission"]))),
            ("structured-acquisition-format", differs("receipt_format", F.lit(forms["receipt"]))),
            ("structured-custody-parity", differs("admission_source_id", "receipt_source_id")),
            ("structured-lane-parity", (size("lane_ids") == 0) | (F.size(F.array_except(F.coalesce("lane_ids", strings), F.coalesce("q_lane_ids", strings))) > 0)),
            ("structured-standing", differs("standing", "expected_standing")),
            ("structured-admission-standing", (F.col("outcome") == "admit-to-review") & (F.col("standing") == "rejected")),
            ("structured-authority", differs("authority_role", F.lit("admission-only")) | differs("raw_retained", F.lit(False)) | effects("graph_effect", "canon_effect")),
            ("structured-route", unrouted, "warning"),
        ]),
        row_rules(attach(of(t["recalled"]), "candidate_id", t["recall"], "id", "r", "packet_id", "generated_by", "continuity_hints"), "id", [
            ("recall-candidate", absent("r")),
            ("recall-custody", ~absent("r") & (differs("packet_id", "r_packet_id") | differs("generated_by", "r_generated_by"))),
            ("recall-continuity", ~absent("r") & outside),
            ("recall-continuity-hint", ~absent("r") & (size("r_continuity_hints") > 0) & ~F.array_contains("r_continuity_hints", F.col("continuity_id")), "warning"),
            ("recall-authority", ~absent("r") & (effects("authority") | idle)),
        ]),
        row_rules(attach(attach(attach(of(t["gaps"]), "lane_id", t["lanes"], "id", "l"), "source_id", t["sources"], "id", "s"), "candidate_id", t["recall"], "id", "r"), "id", [
            ("gap-lane", absent("l")),
            ("gap-question-lane", ~F.coalesce(F.array_contains("q_lane_ids", F.col("lane_id")), F.lit(False))),
            ("gap-continuity", outside), ("gap-detail", blank("detail")),
            ("gap-source", F.col("source_id").isNotNull() & absent("s")),
            ("gap-candidate", F.col("candidate_id").isNotNull() & absent("r"), "warning"),
            ("gap-authority", differs("standing", F.lit("unresolved")) | effects("graph_effect", "canon_effect")),
        ]),
    ]
    ids = union([t[k].select("question_id", F.col("id").cast("string").alias("id")) for k in ("private", "structured", "recalled", "gaps")])
    twice = ids.groupBy("question_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    return union([*parts, finding(twice, "duplicate-reference", "error", F.col("id"))])


# Reviewed answers.


def answer_findings(t: dict[str, DataFrame], form: str) -> DataFrame:
    """Tables: packets (id, format, dossier_id, reviewed_by, reviewed_at, continuity_ids, scope, answer_ready, render_authority, graph_effect, canon_effect),
    dossiers (id, source_ids), transactions (id, packet_id, source_id, continuity_id, passed, evidence_fingerprint, receipt_fingerprint, canon_fingerprint),
    evidence (transaction_id, record_id, role, promoted), resolutions (transaction_id, decision_id, approved, record_ids), claims (id, packet_id, transaction_id, ord,
    continuity_id, text, text_digest, record_ids, decision_ids, candidate_ids), recalled (packet_id, candidate_id), gaps (id, packet_id), references (id,
    packet_id, standing), closures (id, packet_id, gap_id, rationale, claim_ids), limitations (id, packet_id, text, text_digest, gap_ids, reference_ids)."""
    p = attach(attach(t["packets"], "dossier_id", t["dossiers"], "id", "d"), "id", t["claims"], "packet_id", "c")
    p = attach(p, "id", t["limitations"], "packet_id", "m")
    scope = F.when(absent("m"), "bounded-complete").otherwise("partial")
    tr = attach(t["transactions"], "packet_id", t["packets"], "id", "p", "dossier_id")
    tr = attach(attach(tr, "p_dossier_id", t["dossiers"], "id", "d", "source_ids"), "id", t["claims"], "transaction_id", "c")
    cl = attach(attach(t["claims"], "packet_id", t["packets"], "id", "p", "continuity_ids"), "transaction_id", t["transactions"], "id", "t", "continuity_id")
    met = ~absent("t")
    orders = t["claims"].groupBy("packet_id").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    pair = lambda df, a, b, *c: df.groupBy(F.struct(a, b).alias("k")).agg(F.lit(True).alias("is"), *(F.first(x).alias(x) for x in c))
    ev = cl.where(met).select("id", "transaction_id", F.explode("record_ids").alias("r"))
    known = pair(t["evidence"].withColumnRenamed("record_id", "r"), "transaction_id", "r", "role", "promoted")
    ev = ev.join(known, F.struct("transaction_id", "r") == F.col("k"), "left")
    de = cl.where(met).select("id", "transaction_id", "record_ids", F.explode("decision_ids").alias("e"))
    decided = pair(t["resolutions"].withColumnRenamed("decision_id", "e").withColumnRenamed("record_ids", "cited"), "transaction_id", "e", "approved", "cited")
    de = de.join(decided, F.struct("transaction_id", "e") == F.col("k"), "left")
    ca = t["claims"].select("id", "packet_id", F.explode("candidate_ids").alias("candidate_id")).join(t["recalled"].select("packet_id", "candidate_id", F.lit(True).alias("is")).distinct(), ["packet_id", "candidate_id"], "left")
    closed = attach(t["closures"], "gap_id", t["gaps"], "id", "g")
    limits = t["limitations"]
    gaps_of = limits.select("id", F.explode("gap_ids").alias("gap_id"))
    refs_of = limits.select("id", F.explode("reference_ids").alias("reference_id"))
    held = t["references"].where("standing IN ('rejected', 'deferred')")
    from tarnwick.operators.dossier import coverage_findings

    good = F.coalesce("approved", F.lit(False))
    parts = [
        row_rules(p, "id", [
            ("answer-format", differs("format", F.lit(form))), ("answer-dossier-parity", absent("d")), ("answer-reviewer", blank("reviewed_by") | no_time("reviewed_at")), ("answer-empty", absent("c")),
            ("answer-scope", differs("scope", scope)),
            ("answer-authority", differs("answer_ready", F.lit(True)) | differs("render_authority", F.lit("reviewed-text-only")) | effects("graph_effect", "canon_effect")),
        ]),
        duplicates(t["transactions"], "id", "duplicate-transaction"), duplicates(t["claims"], "id", "duplicate-answer-claim"), duplicates(limits, "id", "duplicate-limitation"),
        union([duplicates(t["closures"], "id", "duplicate-gap-closure"), duplicates(t["closures"], "gap_id", "duplicate-gap-closure")]),
        row_rules(tr, "id", [
            ("transaction-source-outside-dossier", ~F.coalesce(F.array_contains("d_source_ids", F.col("source_id")), F.lit(False))),
            ("transaction-not-adjudicated", differs("passed", F.lit(True))),
            ("transaction-custody", blank("evidence_fingerprint") | blank("canon_fingerprint")),
            ("unused-transaction", absent("c")),
        ]),
        finding(orders.where("lo <> 1 OR hi <> n OR d <> n"), "answer-order", "error", F.col("packet_id")),
        row_rules(cl, "id", [
            ("answer-transaction-missing", absent("t")),
            ("answer-continuity", met & ~F.coalesce(F.array_contains("p_continuity_ids", F.col("continuity_id")), F.lit(False))),
            ("answer-transaction-continuity", met & differs("t_continuity_id", "continuity_id")),
            ("answer-text", met & (blank("text") | (F.length("text") > 4000))),
            ("answer-text-digest", met & differs("text_digest", F.concat(F.lit("sha256:"), F.sha2("text", 256)))),
            ("answer-evidence-empty", met & ((size("record_ids") == 0) | (size("decision_ids") == 0))),
        ]),
        row_rules(ev, "id", [("answer-evidence-unknown", F.col("is").isNull()), ("answer-evidence-nonprimary", differs("role", F.lit("primary")) & F.col("is").isNotNull()), ("answer-evidence-not-promoted", ~F.coalesce("promoted", F.lit(False)))]),
        row_rules(de, "id", [("answer-resolution", ~good), ("answer-resolution-evidence", good & ~F.arrays_overlap("record_ids", "cited"))]),
        row_rules(ca, "id", [("candidate-outside-dossier", F.col("is").isNull())]),
        row_rules(closed, "id", [
            ("gap-closure-gap", absent("g")), ("gap-closure-rationale", ~absent("g") & (F.length(F.trim(F.coalesce("rationale", F.lit("")))) < 32)),
            ("gap-closure-claims", ~absent("g") & ((size("claim_ids") == 0) | repeats("claim_ids"))),
        ]),
        missing_reference(t["closures"], "id", "claim_ids", t["claims"], "id", "gap-closure-claim"),
        coverage_findings(t["gaps"].select(F.col("id").alias("gap_id")), t["closures"], gaps_of, held.select(F.col("id").alias("reference_id"), "standing"), refs_of),
        row_rules(limits, "id", [("limitation-text", blank("text") | differs("text_digest", F.concat(F.lit("sha256:"), F.sha2("text", 256))))]),
        missing_reference(gaps_of, "id", "gap_id", t["gaps"], "id", "limitation-gap"), missing_reference(refs_of, "id", "reference_id", held, "id", "limitation-reference"),
    ]
    return union(parts)


# Acquisitions and admissions.


def acquisition_findings(t: dict[str, DataFrame], forms: dict[str, str]) -> DataFrame:
    """Tables: receipts (id, format, fingerprint, source_id, adapter_id, request_id, endpoint, final_endpoint, url, robots_digest, robots_allowed,
    raw_retained, graph_effect, canon_effect, outcome, replay, network_count, attempt_count, gap_id, observation_ids, completed_at, plan_fingerprint),
    adapters (id, source_id, endpoint), plans (fingerprint, request_id), state (request_id, receipt_id, uri), gaps (id), observations (id, source_id),
    attempts (receipt_id)."""
    r = attach(attach(attach(t["receipts"], "adapter_id", t["adapters"], "id", "a", "source_id", "endpoint"), "plan_fingerprint", t["plans"], "fingerprint", "p", "request_id"), "gap_id", t["gaps"], "id", "g")
    good = F.col("outcome") == "success"
    network = ~F.coalesce("replay", F.lit(False))
    seen = t["receipts"].select("id", "source_id", F.explode("observation_ids").alias("o"))
    seen = attach(seen, "o", t["observations"], "id", "o", "source_id")
    first = t["receipts"].where(good & network).groupBy("request_id").agg(F.min("completed_at").alias("first"), F.max(F.struct("completed_at", "id")).alias("last"))
    replays = t["receipts"].where("replay").join(first.select("request_id", "first"), "request_id", "left")
    state = attach(t["state"], "receipt_id", t["receipts"], "id", "r", "request_id").join(first.select(F.col("request_id").alias("n"), F.col("last.id").alias("newest")), F.col("request_id") == F.col("n"), "left")
    name = "structured-acquisition-"
    return union([
        row_rules(r, "id", [
            (name + "receipt-format", differs("format", F.lit(forms["receipt"]))), (name + "receipt-fingerprint", no_digest("fingerprint")),
            (name + "plan-fingerprint", absent("p")), (name + "identity-parity", ~absent("p") & differs("p_request_id", "request_id")),
            (name + "source-contract", absent("a")), (name + "adapter-source", ~absent("a") & differs("a_source_id", "source_id")),
            (name + "requested-endpoint", ~absent("a") & ~F.coalesce(F.col("endpoint").startswith(F.col("a_endpoint")), F.lit(False))),
            (name + "final-endpoint", ~absent("a") & ~F.coalesce(F.col("final_endpoint").startswith(F.col("a_endpoint")), F.lit(False))),
            (name + "requested-url", blank("url") | ~F.coalesce(F.col("url").startswith("https://"), F.lit(False))),
            (name + "robots-route", ~F.coalesce("robots_allowed", F.lit(False))), (name + "robots-digest", no_digest("robots_digest")),
            (name + "raw-retention", differs("raw_retained", F.lit(False))), (name + "authority-leak", effects("graph_effect", "canon_effect")),
            (name + "counts", (F.col("network_count") < 0) | (F.col("attempt_count") < 0)),
            (name + "success-custody", good & (size("observation_ids") == 0)), (name + "success-gap", good & F.col("gap_id").isNotNull()),
            (name + "replay-network", ~network & (F.col("network_count") > 0)), (name + "network-count", network & good & (F.col("network_count") < 1)),
            (name + "gap-missing", ~good & absent("g")),
        ]),
        duplicates(t["receipts"], "id", name + "receipt-duplicate"),
        row_rules(seen, "id", [(name + "observation-missing", absent("o")), (name + "observation-parity", ~absent("o") & differs("o_source_id", "source_id"))]),
        exactly_one(t["receipts"].withColumnRenamed("id", "receipt_id"), t["attempts"], "receipt_id", name + "attempt-count"),
        row_rules(replays, "id", [(name + "replay-origin", F.col("first").isNull() | (F.col("first") > F.col("completed_at")))]),
        duplicates(t["state"], "request_id", name + "state-duplicate-request"),
        row_rules(state, "request_id", [
            (name + "state-receipt-missing", absent("r")), (name + "state-receipt-parity", ~absent("r") & differs("r_request_id", "request_id")),
            (name + "state-uri", ~F.coalesce(safe_relative(F.col("uri")), F.lit(False))),
            (name + "state-latest-success", F.col("newest").isNotNull() & differs("newest", "receipt_id")),
        ]),
    ])


def admission_health(t: dict[str, DataFrame], form: str) -> DataFrame:
    """Tables: admissions (id, format, observation_id, receipt_id, source_id, outcome, reviewed_by, reviewed_at, filename, authority_role, graph_effect,
    canon_effect), receipts (id, source_id, completed_at), observations (id, source_id, retrieved_at), state (observation_id, admission_id, uri).
    The rules about reason, rationale and evidence are those of `dossier.admission_findings`."""
    a = attach(attach(t["admissions"], "receipt_id", t["receipts"], "id", "r", "source_id", "completed_at"), "observation_id", t["observations"], "id", "o", "source_id", "retrieved_at")
    a = attach(a, "observation_id", t["state"], "observation_id", "s")
    order = F.struct("reviewed_at", "id")
    own = t["admissions"].groupBy("observation_id").agg(
        F.max(order).alias("last"), F.countDistinct("outcome").alias("outcomes"), F.countDistinct("reviewed_by").alias("reviewers"), F.max("reviewed_at").alias("at")
    )
    ties = t["admissions"].join(own.select("observation_id", "at"), "observation_id").where("reviewed_at = at").groupBy("observation_id").agg(F.count("*").alias("n")).where("n > 1")
    state = attach(t["state"], "admission_id", t["admissions"], "id", "a", "observation_id").join(own.select(F.col("observation_id").alias("n"), F.col("last.id").alias("newest")), F.col("observation_id") == F.col("n"), "left")
    name = "structured-admission-"
    return union([
        row_rules(a, "id", [
            (name + "format", differs("format", F.lit(form))), (name + "required-identity", blank("observation_id") | blank("receipt_id") | blank("source_id")),
            (name + "portable-filename", ~F.coalesce(F.col("filename").rlike(r"^[a-z0-9][a-z0-9._-]*\.json$"), F.lit(False))),
            (name + "review-time", no_time("reviewed_at")), (name + "authority", differs("authority_role", F.lit("admission-only")) | effects("graph_effect", "canon_effect")),
            (name + "acquisition-missing", absent("r")), (name + "acquisition-parity", ~absent("r") & differs("r_source_id", "source_id")),
            (name + "before-acquisition", F.try_to_timestamp("reviewed_at") < F.try_to_timestamp("r_completed_at")),
            (name + "observation-missing", absent("o")), (name + "observation-parity", ~absent("o") & differs("o_source_id", "source_id")),
            (name + "before-observation", F.try_to_timestamp("reviewed_at") < F.try_to_timestamp("o_retrieved_at")),
            (name + "state-missing", absent("s")),
        ]),
        duplicates(t["admissions"], "id", name + "duplicate"), duplicates(t["state"], "observation_id", name + "state-duplicate-observation"),
        row_rules(state, "observation_id", [
            (name + "state-orphan", absent("a")), (name + "state-uri", ~F.coalesce(safe_relative(F.col("uri")), F.lit(False))),
            (name + "state-parity", ~absent("a") & differs("a_observation_id", "observation_id")), (name + "state-latest", F.col("newest").isNotNull() & differs("newest", "admission_id")),
        ]),
        finding(ties, name + "latest-ambiguous", "error", F.col("observation_id")),
        row_rules(own, "observation_id", [(name + "disposition-drift", F.col("outcomes") > 1, "warning"), (name + "reviewer-change", F.col("reviewers") > 1, "notice")]),
    ])
