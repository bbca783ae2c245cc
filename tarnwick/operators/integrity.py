"""Fingerprints, identities and projections of answers and dossiers: the rules that rebuild a record and compare.

`audits` has the rules over what a record says; these are over what it is made of. Records are tables; a record's
fingerprint covers its columns and those of the records below it (`hashtree`), so a fault in a leaf is found from the
packet, with its path. Tables may have further columns; an empty table gives no findings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import dossier, hashtree
from tarnwick.operators.audits import absent, attach, differs, effects, row_rules
from tarnwick.operators.hashtree import Level
from tarnwick.operators.rules import finding, union

Tables = dict[str, DataFrame]
_STRINGS = "array<string>"


def _unsorted(*columns: str) -> Column:
    """Whether one of these arrays is not sorted or has an element twice."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast(_STRINGS)))).eqNullSafe(F.col(c))
    return out


def _level(t: Tables, name: str, columns: Sequence[str], parent: str | None = None, children: Sequence[Level] = ()) -> Level:
    """A level whose arrays count as JSON."""
    table = t[name]
    nested = {c: F.to_json(c) for c in columns if table.schema[c].dataType.typeName() in ("array", "map", "struct")}
    return Level(name, table.withColumns(nested), columns, parent=parent, stored="fingerprint", children=tuple(children))


def _stale(prints: DataFrame, code: str) -> DataFrame:
    """Records that are not what their own fingerprint says, given the kept ones below them."""
    return finding(prints.where("NOT near <=> stored"), code, "error", F.col("id").cast("string"))


def _identity(table: DataFrame, prints: DataFrame, prefix: str, code: str, *parts: str) -> DataFrame:
    """Ids that are not a prefix and the digest of these columns and the fingerprint that the record should have."""
    own = table.select(F.col("id").alias("_id"), *parts).join(prints.select(F.col("id").alias("_of"), "deep").dropDuplicates(["_of"]), F.col("_id") == F.col("_of"))
    text = F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts), "deep")
    right = identity(prefix, text)
    return finding(own.where(~F.col("_id").eqNullSafe(right)), code, "error", F.col("_id"), right)


def identity(prefix: str, text: Column) -> Column:
    """The id of a record whose parts and fingerprint make this text."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(text, 256), 1, 32))


def answer_tree(t: Tables) -> Level:
    """Packets with their transactions (each with its receipt), claims, closures and limitations."""
    receipts = _level(t, "receipts", ["packet_id", "packet_fingerprint", "passed"], "transaction_id")
    transactions = _level(t, "transactions", ["format", "review_packet_id", "review_packet_fingerprint"], "packet_id", [receipts])
    claims = _level(t, "claims", ["ord", "text", "record_ids", "decision_ids", "candidate_ids", "observation_id", "source_id"], "packet_id")
    closures = _level(t, "closures", ["gap_id", "rationale", "claim_ids"], "packet_id")
    limits = _level(t, "limitations", ["ord", "text", "gap_ids", "reference_ids"], "packet_id")
    return _level(t, "packets", ["dossier_id", "reviewed_by", "rendered_text"], None, [transactions, claims, closures, limits])


def answer_integrity(t: Tables, transaction_format: str) -> DataFrame:
    """Findings of answers. Tables, all with id and fingerprint: packets (dossier_id, reviewed_by, rendered_text), transactions (packet_id, format,
    review_packet_id, review_packet_fingerprint), receipts (transaction_id, packet_id, packet_fingerprint, passed), claims (packet_id, ord, text, record_ids,
    decision_ids, candidate_ids, observation_id, source_id, locator_ids), closures (packet_id, gap_id, rationale, claim_ids), limitations (packet_id, ord,
    text, gap_ids, reference_ids); and gaps (id, candidate_id, observation_id, source_id)."""
    root = answer_tree(t)
    seen = hashtree.prints(root)
    found = hashtree.faults(root, seen)
    code = {"packets": "answer-fingerprint", "transactions": "transaction-fingerprint"}
    rebuilt = {
        "claims": ("answer-claim-projection", _unsorted("record_ids", "decision_ids", "candidate_ids")),
        "closures": ("gap-closure-projection", _unsorted("claim_ids")),
        "limitations": ("limitation-projection", _unsorted("gap_ids", "reference_ids")),
    }
    tr = attach(t["transactions"], "id", t["receipts"], "transaction_id", "r", "packet_id", "packet_fingerprint")
    gaps = t["gaps"].select(F.col("id").alias("gap_id"), *(F.col(c).alias(f"g_{c}") for c in ("candidate_id", "observation_id", "source_id")))
    named = t["closures"].select("id", "gap_id", F.explode_outer("claim_ids").alias("claim_id")).join(gaps, "gap_id")
    claims = t["claims"].select(F.col("id").alias("claim_id"), "candidate_ids", "observation_id", "source_id")
    named = named.join(claims, "claim_id", "left")
    meets = {
        "candidate": F.coalesce(F.array_contains("candidate_ids", F.col("g_candidate_id")), F.lit(False)),
        "observation": F.col("observation_id").eqNullSafe(F.col("g_observation_id")),
        "source": F.col("source_id").eqNullSafe(F.col("g_source_id")),
    }
    met = named.groupBy("id").agg(*(F.max(m).alias(f"met_{k}") for k, m in meets.items()), *(F.first(f"g_{k}_id").alias(f"g_{k}") for k in meets))
    told = dossier.render_answers(t["claims"].withColumnRenamed("packet_id", "answer_id"), t["limitations"].withColumnRenamed("packet_id", "answer_id"))
    text = t["packets"].join(told.select(F.col("answer_id").alias("id"), F.col("text").alias("expected")), "id", "left")
    return union([
        *(finding(found.where(F.col("level") == name), c, "error", F.col("id"), F.concat_ws(" ", "cause", "path")) for name, c in code.items()),
        _stale(seen["receipts"], "reconciliation-receipt-fingerprint"),
        _identity(t["packets"], seen["packets"], "answer", "answer-identity", "dossier_id"),
        _identity(t["transactions"], seen["transactions"], "transaction", "transaction-identity", "review_packet_id", "review_packet_fingerprint"),
        row_rules(tr, "id", [
            ("transaction-format", differs("format", F.lit(transaction_format))),
            ("transaction-packet-parity", absent("r") | differs("r_packet_id", "review_packet_id") | differs("r_packet_fingerprint", "review_packet_fingerprint")),
        ]),
        *(union([_stale(seen[name], c), finding(t[name].where(wrong), c, "error", F.col("id"))]).dropDuplicates(["subject"]) for name, (c, wrong) in rebuilt.items()),
        *(finding(met.where(F.col(f"g_{k}").isNotNull() & ~F.col(f"met_{k}")), f"gap-closure-{k}", "error", F.col("id")) for k in meets),
        finding(text.where(differs("rendered_text", F.coalesce("expected", F.lit("")))), "rendered-text", "error", F.col("id")),
    ])


def dossier_tree(t: Tables) -> Level:
    """Dossiers with their route and their structured references, each with its admission and acquisition."""
    admissions = _level(t, "admissions", ["outcome", "reason", "evidence_digests"], "reference_id")
    acquisitions = _level(t, "acquisitions", ["request_id", "response_digest", "status"], "reference_id")
    structured = _level(t, "structured", ["standing", "continuity_id", "lane_ids"], "dossier_id", [admissions, acquisitions])
    route = _level(t, "routes", ["lane_ids", "source_ids"], "dossier_id")
    return _level(t, "dossiers", ["question_id", "next_actions", "standing_counts"], None, [route, structured])


def dossier_integrity(t: Tables, form: str) -> DataFrame:
    """Findings of dossiers. Tables, with id and fingerprint: dossiers (format, question_id, next_actions, expected_actions, standing_counts: map, evidence_ready,
    answer_ready, authority, graph_effect, canon_effect, answer_effect), routes (dossier_id, lane_ids, source_ids), structured (dossier_id, standing,
    continuity_id, lane_ids), admissions (reference_id, outcome, reason, evidence_digests), acquisitions (reference_id, request_id, response_digest, status);
    and lane_sources (lane_id, source_id), references (dossier_id, standing) of all kinds."""
    root = dossier_tree(t)
    seen = hashtree.prints(root)
    found = hashtree.faults(root, seen)
    by_level = lambda name, code: finding(found.where(F.col("level") == name), code, "error", F.col("id"), F.concat_ws(" ", "cause", "path"))
    # What the lanes of a route lead to, as a multiset of pairs that need not be collected: sizes and overlaps are counted.
    asked = t["routes"].select("id", F.explode("lane_ids").alias("lane_id")).join(t["lane_sources"], "lane_id").select("id", "source_id").distinct().withColumn("due", F.lit(1))
    said = t["routes"].select("id", F.explode("source_ids").alias("source_id")).distinct().withColumn("said", F.lit(1))
    drift = asked.join(said, ["id", "source_id"], "full").where("due IS NULL OR said IS NULL").select("id").distinct()
    counted = t["references"].groupBy("dossier_id", "standing").agg(F.count("*").alias("n"))
    kept = t["dossiers"].select(F.col("id").alias("dossier_id"), F.explode("standing_counts").alias("standing", "kept"))
    counts = counted.join(kept, ["dossier_id", "standing"], "full").where("coalesce(n, 0) <> coalesce(kept, 0)").select("dossier_id").distinct()
    acquisitions = union([_stale(seen["acquisitions"], "structured-acquisition-integrity"), _identity(t["acquisitions"], seen["acquisitions"], "acquisition", "structured-acquisition-integrity", "request_id")])
    return union([
        row_rules(t["dossiers"], "id", [
            ("dossier-format", differs("format", F.lit(form))),
            ("next-actions", differs("next_actions", "expected_actions")),
            ("dossier-authority", differs("evidence_ready", F.lit(False)) | differs("answer_ready", F.lit(False)) | effects("authority", "graph_effect", "canon_effect", "answer_effect")),
        ]),
        finding(counts, "standing-counts", "error", F.col("dossier_id")),
        by_level("dossiers", "dossier-fingerprint"), by_level("routes", "route-fingerprint"),
        _identity(t["dossiers"], seen["dossiers"], "dossier", "dossier-identity", "question_id"),
        finding(drift, "route-source-parity", "error", F.col("id")),
        acquisitions.dropDuplicates(["subject"]),
        _stale(seen["admissions"], "structured-admission-fingerprint"),
        _identity(t["admissions"], seen["admissions"], "admission", "structured-admission-id", "reference_id"),
    ])
