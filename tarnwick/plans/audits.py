"""Queries of the audits: estates made of documents, in which each hundred-and-first row is wrong in one way.

The SQL says which rows each rule has to find, by the residue of doc_id, and knows nothing of the rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators import audits
from tarnwick.plans.catalogue import query, table


def n() -> Column:
    return F.col("n")


def own_id() -> Column:
    return n().cast("string")


def null() -> Column:
    return F.lit(None).cast("string")


def digest() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(own_id(), 256))


def empty() -> Column:
    return F.array().cast("array<string>")


def b(k: int, wrong, right) -> Column:
    """`wrong` in rows of residue k."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(n() % 101 == k, value(wrong)).otherwise(value(right))


def ref(k: int) -> Column:
    """The row's own id, in rows of residue k one that is nobody's."""
    return b(k, F.concat(F.lit("x"), n().cast("string")), n().cast("string"))


def base(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("n"))


def rows(df: DataFrame, twice: Iterable[int] = (), without: Iterable[int] = (), **columns: Column | str | int | bool) -> DataFrame:
    """A table of columns: rows of residues in `twice` twice, those in `without` not."""
    left = df.where(~(n() % 101).isin(list(without))) if without else df
    left = left.unionByName(left.where((n() % 101).isin(list(twice)))) if twice else left
    return left.select(*((c if isinstance(c, Column) else F.lit(c)).alias(name) for name, c in columns.items()))


def counted(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("n"))


def expected(*errors: tuple[str, str], **other: dict[str, str]) -> str:
    """SQL for (code, residues) pairs, residues as a list such as '3, 5'; further severities by name."""
    every = [(c, "error", r) for c, r in errors] + [(c, s, r) for s, codes in other.items() for c, r in codes.items()]
    cases = ", ".join(f"CASE WHEN doc_id % 101 IN ({r}) THEN '{c} {s}' END" for c, s, r in every)
    return f"""WITH f AS (SELECT unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS f FROM documents)
SELECT split_part(f, ' ', 1) AS code, split_part(f, ' ', 2) AS severity, count(*) AS n FROM f GROUP BY ALL"""


@query(expected(
    ("invalid-format", "1"), ("invalid-generator", "2"), ("recall-claims-authority", "3"), ("recall-claims-compilation-standing", "4"), ("invalid-knowledge-cutoff", "5"), ("missing-universe", "6"), ("missing-scope", "7"),
    ("missing-label", "8"), ("missing-summary", "9"), ("invalid-confidence", "10, 11"), ("missing-source-hint", "12"), ("missing-continuity-hint", "13"), ("missing-reconciliation-key", "14"), ("recall-claims-source-standing", "15"),
    ("raw-url-source-hint", "16"), ("duplicate-candidate-id", "17"), ("duplicate-packet-id", "18"), ("duplicate-estate-candidate-id", "17"), ("duplicate-source-hint-id", "19"), ("unknown-source-hint", "16, 20"),
))
def audit_recall(spark, d):
    df = base(spark, d)
    packets = rows(df, [18], id=own_id(), format=b(1, "old", "packet/1"), generated_by=b(2, "hand", "language-model-recall"), authority=b(3, "some", "none"), compilation_eligible=b(4, True, False), knowledge_cutoff=b(5, "2024", "2024-06"), universe_id=b(6, " ", "u"), scope=b(7, null(), "s"))
    hint = b(16, F.concat(F.lit("HTTPS://x/"), own_id()), ref(20))
    candidates = rows(
        df, [17], packet_id=own_id(), id=own_id(), label=b(8, "", "l"), summary=b(9, null(), "s"), confidence_permille=b(10, 1001.0, b(11, 1.5, 700.0)), source_hints=b(12, empty(), F.array(hint)), continuity_hints=b(13, empty(), F.array(F.lit("m"))),
        reconciliation_keys=b(14, F.lit(None).cast("array<string>"), F.array(F.lit("k"))), normalized=b(15, F.create_map(F.lit("quote"), F.lit("q")), F.create_map(F.lit("name"), F.lit("q"))),
    )
    return counted(audits.recall_findings(packets, candidates, rows(df, [19], id=own_id()), "packet/1"))


@query(expected(
    ("evidence-format", "1"), ("missing-universe", "2"), ("source-universe-mismatch", "2, 3"), ("duplicate-source", "4"), ("duplicate-locator", "5"), ("duplicate-evidence-record", "6"), ("incomplete-source", "7"), ("missing-continuity", "8, 20"),
    ("record-continuity-mismatch", "8, 20, 21"), ("missing-source-hint", "9"), ("invalid-sha256", "10, 17"), ("invalid-file-size", "11, 12"), ("unknown-locator-source", "13"), ("missing-locator-unit", "14"), ("invalid-locator-range", "15, 16"),
    ("unknown-record-source", "18"), ("incomplete-evidence-record", "19"), ("missing-record-locator", "22"), ("duplicate-record-locator", "23"), ("missing-reconciliation-key", "24"), ("missing-evidence-reviewer", "25"),
    ("unknown-record-locator", "27"), ("cross-source-locator", "13, 18"), warning={"premature-reviewer": "26", "empty-evidence-bundle": "28"},
))
def audit_evidence(spark, d):
    df = base(spark, d)
    bundles = rows(df, id=own_id(), format=b(1, "old", "bundle/1"), universe_id=b(2, "", "u"))
    sources = rows(df, [4], id=own_id(), bundle_id=b(28, "other", own_id()), title=b(7, " ", "t"), version=F.lit("1"), universe_id=b(3, "v", "u"), continuity_id=b(8, "", "m"), source_hint_ids=b(9, empty(), F.array(F.lit("h"))), digest=b(10, "sha256:XY", digest()), file_size_bytes=b(11, 0.0, b(12, 2.5, 10.0)))
    # the bundle that has no sources is another's, so its source's universe is unknown
    sources = sources.withColumn("bundle_id", F.when(F.col("bundle_id") == "other", "0").otherwise(F.col("bundle_id")))
    locators = rows(df, [5], id=own_id(), source_id=ref(13), unit=b(14, "", "p"), start=b(15, -1.0, b(16, 9.0, 1.0)), end=F.lit(5.0), content_digest=b(17, F.lit("x"), null()))
    records = rows(
        df, [6], id=own_id(), source_id=ref(18), label=b(19, "", "l"), continuity_id=b(20, "", b(21, "other", "m")), locator_ids=b(22, empty(), b(23, F.array(own_id(), own_id()), F.array(ref(27)))), reconciliation_keys=b(24, empty(), F.array(own_id())),
        review_status=b(26, "machine-extracted", "reviewed"), reviewed_by=b(25, null(), "Ann"),
    )
    return counted(audits.evidence_findings(bundles, sources, locators, records, "bundle/1"))


@query(expected(
    ("decision-format", "1"), ("incomplete-decision-set", "2"), ("work-order-id-mismatch", "3"), ("work-order-fingerprint-mismatch", "3, 4"), ("evidence-bundle-mismatch", "5, 6"), ("duplicate-decision", "7"), ("invalid-confirm-shape", "8, 17, 23"),
    ("invalid-defer-shape", "9"), ("missing-rationale", "10"), ("missing-candidate", "8"), ("duplicate-decision-candidate", "23"), ("duplicate-decision-record", "12"), ("missing-recall-candidate", "13"), ("candidate-outside-work-order", "14"),
    ("unknown-evidence-record", "15"), ("missing-usable-evidence", "15"), ("promotion-without-evidence", "16"), ("unreviewed-promotion", "18"), ("missing-evidence-reviewer", "19"), ("reconciliation-key-mismatch", "20"), ("cross-cluster-merge", "21"),
    ("candidate-double-decision", "22"), notice={"pending-review": "8, 14"},
))
def audit_decisions(spark, d):
    df = base(spark, d)
    none = empty()
    sets = rows(df, id=own_id(), format=b(1, "old", "set/1"), reviewer_id=b(2, "", "ann"), work_order_id=ref(3), work_order_fingerprint=b(4, "x", "f"), evidence_bundle_id=ref(5), evidence_bundle_fingerprint=b(6, "x", "e"))
    # a set that names another's order: nobody waits for its own
    orders, bundles = rows(df, id=own_id(), fingerprint=F.lit("f")), rows(df, id=own_id(), fingerprint=F.lit("e"))
    two = F.array(own_id(), F.concat(own_id(), F.lit("b")))
    work = rows(df, work_order_id=own_id(), candidate_id=own_id(), cluster_id=own_id()).unionByName(rows(df.where("n % 101 IN (21, 24)"), work_order_id=own_id(), candidate_id=F.concat(own_id(), F.lit("b")), cluster_id=b(21, F.concat(own_id(), F.lit("b")), own_id())))
    candidates = rows(df, without=[13], id=own_id(), reconciliation_keys=F.array(own_id())).unionByName(rows(df.where("n % 101 IN (21, 24)"), id=F.concat(own_id(), F.lit("b")), reconciliation_keys=F.array(own_id())))
    records = rows(df, id=own_id(), reconciliation_keys=b(20, F.array(F.lit("other")), F.array(own_id())), review_status=b(18, "machine-extracted", "reviewed"), reviewed_by=b(19, null(), "Ann"))
    decisions = rows(
        df, [7], set_id=own_id(), id=own_id(), action=b(21, "merge", b(24, "merge", b(9, "defer", b(15, "reject", "confirm")))), candidate_ids=b(8, none, b(21, two, b(24, two, b(23, F.array(own_id(), own_id()), F.array(ref(14)))))),
        evidence_ids=b(15, F.array(F.lit("nobody")), b(12, F.array(own_id(), own_id()), b(16, F.array(F.lit("0")), F.array(own_id())))), promoted_ids=b(9, none, b(15, none, b(17, none, F.array(own_id())))), rationale=b(10, " ", "because"),
    ).unionByName(rows(df.where("n % 101 = 22"), set_id=own_id(), id=F.concat(own_id(), F.lit("again")), action=F.lit("reject"), candidate_ids=F.array(own_id()), evidence_ids=F.array(own_id()), promoted_ids=none, rationale=F.lit("r")))
    return counted(audits.decision_set_findings(sets, orders, bundles, work, candidates, records, decisions, "set/1"))


@query(expected(
    ("unknown-source-ledger-row", "1"), ("missing-source-ledger-row", "1"), ("source-ledger-authority-leak", "2"), ("duplicate-source-ledger-row", "3"), ("observation-unknown-source", "4"), ("body-retention-rights-mismatch", "5"), ("missing-observation-credit", "6"),
    ("missing-observation-receipt", "8, 9"), ("missing-public-credit", "10"), ("candidate-authority-leak", "11"), ("collector-promotion-leak", "12"), ("candidate-missing-observation", "13"), ("cache-missing-observation", "14"),
    ("cache-source-mismatch", "4, 15"), ("cache-digest-mismatch", "16"), ("unsafe-cache-path", "17"), ("missing-cache-file", "18"), ("duplicate-public-credit", "19"), ("credit-missing-observation", "20"), ("missing-public-credit", "20"), ("public-credit-overreach", "7, 21"),
    ("credit-source-mismatch", "4, 21"), ("missing-attempt-receipt", "22"), ("health-observation-unknown-source", "23"), ("health-observation-authority-leak", "24"), ("health-observation-digest", "25"), ("observation-count-drift", "1, 4, 26"), ("candidate-count-drift", "1, 27"),
    ("gap-count-drift", "1, 28"), ("attempt-count-drift", "1, 29"), ("credit-count-drift", "1, 10, 19, 21"), warning={"unnecessary-observation-credit": "7", "orphan-cache-file": "17, 18"},
) + " UNION ALL SELECT 'source-ledger-count', 'error', 1 WHERE (SELECT count(*) FROM documents WHERE doc_id % 101 = 3) > 0")
def audit_estate(spark, d):
    df = base(spark, d)
    uri = lambda p: F.concat(F.lit(p), own_id())
    t = {
        "atlas": rows(df, id=own_id(), rights=b(7, "closed", "CC-BY"), body_allowed=b(5, False, True)),
        "ledger": rows(df, [3], source_id=ref(1), graph_effect=b(2, "some", "none"), canon_effect=F.lit("none"), observation_count=b(26, 9, 1), candidate_count=b(27, 9, 1), gap_count=b(28, 9, 1), attempt_count=b(29, 9, 1), credit_count=F.lit(1)),
        "observations": rows(df, id=own_id(), source_id=ref(4), retention=F.lit("licensed-structured-body"), has_credit=b(6, False, True), receipt_uri=b(8, uri("../r/"), b(9, uri("gone/"), uri("r/"))), content_digest=digest()),
        "candidates": rows(df, id=own_id(), source_id=own_id(), observation_ids=F.array(ref(13)), promotion_status=b(12, "promoted", "intake-only"), graph_effect=F.lit("none"), canon_effect=b(11, null(), "none")),
        "cache": rows(df, key=own_id(), source_id=b(15, "other", own_id()), observation_id=ref(14), content_digest=b(16, "x", digest()), uri=b(17, uri("../cache/"), b(18, uri("lost/"), uri("cache/")))),
        "files": rows(df, uri=uri("r/")).unionByName(rows(df, uri=uri("cache/"))),
        "credits": rows(df, [19], [10], observation_id=ref(20), source_id=b(21, "other", own_id())),
        "gaps": rows(df, source_id=own_id()),
        "attempts": rows(df, source_id=own_id(), id=own_id(), receipt_uri=b(22, uri("gone/"), b(30, null(), uri("r/")))),
        "routes": rows(df, id=own_id(), source_id=ref(23), graph_effect=b(24, "some", "none"), canon_effect=F.lit("none"), route_digest=digest(), robots_digest=b(25, null(), digest()), terms_digest=digest()),
    }
    return counted(audits.estate_findings(t))


@query(expected(
    ("question-format", "1"), ("question-digest", "2"), ("question-creator", "3"), ("question-lanes", "4, 5"), ("question-continuities", "6"), ("question-continuity-mix", "7"), ("question-cross-continuity-reason", "8"), ("question-analogue-continuity", "9"), ("question-authority", "10"),
    ("route-format", "11"), ("route-lane-parity", "12"), ("private-source", "13, 14"), ("private-continuity", "6, 15"), ("private-source-continuity", "15"), ("private-custody", "17"), ("private-snippet-digest", "18"), ("private-snippet-size", "19"), ("private-authority", "20"),
    ("structured-source", "22"), ("structured-continuity", "6, 23"), ("structured-source-continuity", "23"), ("structured-admission-format", "24"), ("structured-acquisition-format", "25"), ("structured-custody-parity", "26"), ("structured-lane-parity", "4, 5, 27"), ("structured-standing", "28"),
    ("structured-admission-standing", "29"), ("structured-authority", "30"), ("recall-candidate", "31"), ("recall-custody", "32"), ("recall-continuity", "6, 33"), ("recall-authority", "35"), ("gap-lane", "36"), ("gap-question-lane", "4, 5, 36"), ("gap-continuity", "6, 37"), ("gap-detail", "38"),
    ("gap-source", "39"), ("gap-authority", "41"), ("duplicate-reference", "42"), warning={"private-lane": "4, 5, 21", "structured-route": "4, 5, 21", "recall-continuity-hint": "33, 34", "gap-candidate": "40"},
))
def audit_questions(spark, d):
    df = base(spark, d)
    lane, m, none = F.concat(F.lit("lane"), own_id()), F.array(F.lit("m")), F.lit("none")
    two = F.array(F.lit("m"), F.lit("n"))
    ref_id = lambda p: F.concat(F.lit(p), own_id())
    idle = {"graph_effect": none, "canon_effect": none}
    lanes_of = b(4, empty(), b(5, F.array(F.lit("z")), F.array(lane)))
    t = {
        "lanes": rows(df, id=lane, policy=b(7, "same-continuity-required", b(9, "analogue-only", "any"))),
        "sources": rows(df, id=own_id(), mode=b(14, "open", "local-private-only"), continuity_ids=m, lane_ids=b(21, F.array(F.lit("q")), F.array(lane))),
        "recall": rows(df, id=own_id(), packet_id=F.lit("p"), generated_by=F.lit("g"), continuity_hints=b(34, F.array(F.lit("x")), m)),
        "questions": rows(
            df, id=own_id(), format=b(1, "old", "question/1"), digest=b(2, "x", digest()), created_by=F.lit("ann"), created_at=b(3, "soon", "2024-01-01T00:00:00Z"), lane_ids=lanes_of, continuity_ids=b(6, empty(), b(7, two, b(8, two, m))), reason=b(7, "why", null()), analogue=b(9, False, True),
            text_retained=b(10, True, False), authority=none, answer_effect=none, route_format=b(11, "old", "route/1"), route_lane_ids=b(12, empty(), lanes_of), **idle,
        ),
        "private": rows(
            df, id=ref_id("p"), question_id=own_id(), source_id=ref(13), continuity_id=b(15, "x", "m"), edition_key=F.lit("e"), unit_id=F.lit("u"), paragraph_id=F.lit("p"), locator=b(17, "a/../b", "a/b"), paragraph_digest=digest(), snippet_digest=b(18, F.lit("x"), null()), snippet_characters=b(19, 3000, 90),
            text_retained=F.lit(False), standing=b(20, "proof", "navigation-only"), **idle,
        ),
        "structured": rows(
            df, id=ref_id("s"), question_id=own_id(), source_id=ref(22), continuity_id=b(23, "x", "m"), admission_format=b(24, "old", "admission/1"), admission_source_id=own_id(), receipt_format=b(25, "old", "receipt/1"), receipt_source_id=b(26, "x", own_id()), lane_ids=b(27, empty(), F.array(lane)),
            standing=b(28, "deferred", b(29, "rejected", "supporting-only")), expected_standing=b(29, "rejected", "supporting-only"), outcome=F.lit("admit-to-review"), authority_role=b(30, "all", "admission-only"), raw_retained=F.lit(False), **idle,
        ),
        "recalled": rows(df, id=b(42, ref_id("p"), ref_id("r")), question_id=own_id(), candidate_id=ref(31), packet_id=b(32, "q", "p"), generated_by=F.lit("g"), continuity_id=b(33, "x", "m"), authority=b(35, "some", "none"), standing=F.lit("navigation-only"), **idle),
        "gaps": rows(df, id=ref_id("g"), question_id=own_id(), lane_id=b(36, F.lit("nowhere"), lane), continuity_id=b(37, "x", "m"), detail=b(38, " ", "d"), source_id=ref(39), candidate_id=ref(40), standing=b(41, "closed", "unresolved"), **idle),
    }
    return counted(audits.question_findings(t, {"question": "question/1", "route": "route/1", "admission": "admission/1", "receipt": "receipt/1"}))


@query(expected(
    ("answer-format", "1"), ("answer-dossier-parity", "2"), ("transaction-source-outside-dossier", "2, 11"), ("answer-reviewer", "3"), ("answer-empty", "4"), ("unused-transaction", "4, 20"), ("answer-scope", "5"), ("answer-authority", "6"), ("duplicate-transaction", "7"), ("duplicate-answer-claim", "8"),
    ("answer-order", "8, 14"), ("duplicate-gap-closure", "9"), ("duplicate-gap-closure", "9"), ("duplicate-limitation", "10"), ("transaction-not-adjudicated", "12"), ("transaction-custody", "13"), ("answer-continuity", "15"), ("answer-transaction-continuity", "15, 16"), ("answer-text", "17"),
    ("answer-text-digest", "18"), ("answer-evidence-empty", "19"), ("answer-transaction-missing", "20"), ("answer-evidence-unknown", "21"), ("answer-evidence-not-promoted", "21, 23"), ("answer-evidence-nonprimary", "22"), ("answer-resolution", "24"), ("answer-resolution-evidence", "19, 21, 25"),
    ("candidate-outside-dossier", "26"), ("gap-closure-gap", "27"), ("gap-closure-rationale", "28"), ("gap-closure-claims", "29"), ("gap-closure-claim", "4, 30"), ("uncovered-gap", "27, 31"), ("gap-both-closed-and-limited", "32"), ("uncovered-disposition", "33"), ("limitation-text", "34"),
    ("limitation-gap", "35"), ("limitation-reference", "36"),
))
def audit_answers(spark, d):
    df = base(spark, d)
    sha_of = lambda c: F.concat(F.lit("sha256:"), F.sha2(c, 256))
    text = b(17, F.lit(" "), F.concat(F.lit("claim "), own_id()))
    said, m = F.concat(F.lit("limit "), own_id()), F.array(F.lit("m"))
    t = {
        "packets": rows(df, id=own_id(), format=b(1, "old", "answer/1"), dossier_id=ref(2), reviewed_by=b(3, "", "Ann"), reviewed_at=F.lit("2024-01-01T00:00:00Z"), continuity_ids=m, scope=b(5, "bounded-complete", "partial"), answer_ready=F.lit(True), render_authority=b(6, "all", "reviewed-text-only"), graph_effect=F.lit("none"), canon_effect=F.lit("none")),
        "dossiers": rows(df, id=own_id(), source_ids=F.array(own_id())),
        "transactions": rows(df, [7], id=own_id(), packet_id=own_id(), source_id=ref(11), continuity_id=b(16, "x", "m"), passed=b(12, False, True), evidence_fingerprint=digest(), receipt_fingerprint=digest(), canon_fingerprint=b(13, null(), digest())),
        "evidence": rows(df, transaction_id=own_id(), record_id=own_id(), role=b(22, "analogue", "primary"), promoted=b(23, False, True)),
        "resolutions": rows(df, transaction_id=own_id(), decision_id=own_id(), approved=b(24, False, True), record_ids=b(25, empty(), F.array(own_id()))),
        "claims": rows(df, [8], [4], id=own_id(), packet_id=own_id(), transaction_id=ref(20), ord=b(14, 2, 1), continuity_id=b(15, "x", "m"), text=text, text_digest=b(18, "x", sha_of(text)), record_ids=b(19, empty(), F.array(ref(21))), decision_ids=F.array(own_id()), candidate_ids=F.array(ref(26))),
        "recalled": rows(df, packet_id=own_id(), candidate_id=own_id()),
        "gaps": rows(df, id=own_id(), packet_id=own_id()),
        "references": rows(df, id=own_id(), packet_id=own_id(), standing=b(36, "supporting-only", "rejected")),
        "closures": rows(df, [9], [31], id=own_id(), packet_id=own_id(), gap_id=ref(27), rationale=b(28, "short", "it was looked up and found in the named place"), claim_ids=b(29, F.array(own_id(), own_id()), F.array(ref(30)))),
        "limitations": rows(df, [10], id=own_id(), packet_id=own_id(), text=said, text_digest=b(34, "x", sha_of(said)), gap_ids=b(32, F.array(own_id()), b(35, F.array(F.lit("nobody")), empty())), reference_ids=b(33, empty(), F.array(own_id()))),
    }
    return counted(audits.answer_findings(t, "answer/1"))


_A = "structured-acquisition-"


@query(expected(
    (_A + "receipt-format", "1"), (_A + "receipt-fingerprint", "2"), (_A + "plan-fingerprint", "3"), (_A + "identity-parity", "4"), (_A + "source-contract", "5"), (_A + "adapter-source", "6"), (_A + "requested-endpoint", "7"), (_A + "final-endpoint", "8"), (_A + "requested-url", "9"), (_A + "robots-route", "10"),
    (_A + "robots-digest", "11"), (_A + "raw-retention", "12"), (_A + "authority-leak", "13"), (_A + "counts", "14"), (_A + "success-custody", "15"), (_A + "success-gap", "16"), (_A + "replay-network", "17"), (_A + "network-count", "18, 14"), (_A + "gap-missing", "19"), (_A + "receipt-duplicate", "20"),
    (_A + "observation-missing", "21"), (_A + "observation-parity", "22, 6"), (_A + "attempt-count", "23"), (_A + "replay-origin", "17, 24"), (_A + "state-duplicate-request", "25"), (_A + "state-receipt-missing", "26"), (_A + "state-latest-success", "26, 4"), (_A + "state-uri", "27"), (_A + "state-receipt-parity", "4"), (_A + "state-receipt-parity", "4"),
))
def audit_acquisitions(spark, d):
    df = base(spark, d)
    none = F.lit("none")
    t = {
        "receipts": rows(
            df, [20], id=own_id(), format=b(1, "old", "receipt/1"), fingerprint=b(2, "x", digest()), source_id=b(6, "x", own_id()), adapter_id=ref(5), request_id=b(4, F.concat(F.lit("o"), own_id()), own_id()), plan_fingerprint=ref(3), endpoint=b(7, "https://b/", "https://a/x"), final_endpoint=b(8, "https://b/", "https://a/y"),
            url=b(9, "http://a/", "https://a/x"), robots_digest=b(11, null(), digest()), robots_allowed=b(10, False, True), raw_retained=b(12, True, False), graph_effect=b(13, "some", "none"), canon_effect=none, outcome=b(19, "error", b(28, "error", "success")), replay=b(17, True, b(24, True, False)),
            network_count=b(14, -1, b(18, 0, b(24, 0, 1))), attempt_count=F.lit(1), gap_id=b(16, own_id(), b(28, own_id(), null())), observation_ids=b(15, empty(), F.array(ref(21))), completed_at=F.lit("2024-01-01T00:00:00Z"),
        ),
        "adapters": rows(df, id=own_id(), source_id=own_id(), endpoint=F.lit("https://a/")), "plans": rows(df, fingerprint=own_id(), request_id=own_id()), "gaps": rows(df, id=own_id()),
        "observations": rows(df, id=own_id(), source_id=b(22, "x", own_id())), "attempts": rows(df, without=[23], receipt_id=own_id()).unionByName(rows(df.where("n % 101 = 0"), receipt_id=F.lit("y"))),
        "state": rows(df, [25], request_id=b(4, F.concat(F.lit("p"), own_id()), own_id()), receipt_id=ref(26), uri=b(27, "../a", "a/b")),
    }
    # residue 4: the state's request is not the receipt's, and the receipt's newest belongs to a request that no state has
    t["state"] = t["state"].unionByName(rows(df.where("n % 101 = 4"), request_id=F.concat(F.lit("o"), own_id()), receipt_id=F.lit("1"), uri=F.lit("a")))
    return counted(audits.acquisition_findings(t, {"receipt": "receipt/1"}))


_S = "structured-admission-"


@query(expected(
    (_S + "format", "1"), (_S + "required-identity", "2"), (_S + "portable-filename", "3"), (_S + "review-time", "4"), (_S + "authority", "5"), (_S + "acquisition-missing", "6"), (_S + "acquisition-parity", "2, 7"), (_S + "before-acquisition", "8"), (_S + "observation-missing", "9"), (_S + "observation-parity", "2, 10"),
    (_S + "before-observation", "8, 11"), (_S + "state-missing", "9, 12"), (_S + "duplicate", "13"), (_S + "state-duplicate-observation", "14"), (_S + "state-orphan", "15"), (_S + "state-uri", "16"), (_S + "state-parity", "9"), (_S + "state-latest", "15, 17"), (_S + "latest-ambiguous", "18, 13"),
    warning={_S + "disposition-drift": "17"}, notice={_S + "reviewer-change": "17"},
))
def audit_admissions(spark, d):
    df = base(spark, d)
    at = lambda x: F.lit(f"2024-01-0{x}T00:00:00Z")
    own = {"format": b(1, "old", "admission/1"), "observation_id": ref(9), "receipt_id": ref(6), "source_id": b(2, "", own_id()), "filename": b(3, "A b.json", "a.json"), "authority_role": b(5, "all", "admission-only"), "graph_effect": F.lit("none"), "canon_effect": F.lit("none")}
    first = rows(df, [13], id=own_id(), outcome=F.lit("admit"), reviewed_by=F.lit("Ann"), reviewed_at=b(4, F.lit("soon"), b(8, at(1), at(5))), **own)
    later = rows(df.where("n % 101 IN (17, 18)"), id=F.concat(own_id(), F.lit("b")), outcome=b(17, "reject", "admit"), reviewed_by=b(17, "Bob", "Ann"), reviewed_at=b(17, at(6), at(5)), **own)
    t = {
        "admissions": first.unionByName(later), "receipts": rows(df, id=own_id(), source_id=b(7, "x", own_id()), completed_at=at(2)),
        "observations": rows(df, id=own_id(), source_id=b(10, "x", own_id()), retrieved_at=b(11, at(7), at(2))),
        "state": rows(df, [14], [12], observation_id=own_id(), admission_id=b(15, F.lit("gone"), b(18, F.concat(own_id(), F.lit("b")), own_id())), uri=b(16, "/a", "a/b")),
    }
    return counted(audits.admission_health(t, "admission/1"))
