"""Answers and dossiers that are whole give no finding; each planted fault gives its code, and those of what stands above it."""

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import hashtree, integrity

ANSWER = {
    "packets": "id string, dossier_id string, reviewed_by string, rendered_text string",
    "transactions": "id string, packet_id string, format string, review_packet_id string, review_packet_fingerprint string",
    "receipts": "id string, transaction_id string, packet_id string, packet_fingerprint string, passed boolean",
    "claims": "id string, packet_id string, ord int, text string, record_ids array<string>, decision_ids array<string>, candidate_ids array<string>, observation_id string, source_id string, locator_ids array<string>",
    "closures": "id string, packet_id string, gap_id string, rationale string, claim_ids array<string>",
    "limitations": "id string, packet_id string, ord int, text string, gap_ids array<string>, reference_ids array<string>",
    "gaps": "id string, candidate_id string, observation_id string, source_id string",
}
DOSSIER = {
    "dossiers": "id string, format string, question_id string, next_actions array<string>, expected_actions array<string>, standing_counts map<string,bigint>, evidence_ready boolean, answer_ready boolean, authority string, graph_effect string, canon_effect string, answer_effect string",
    "routes": "id string, dossier_id string, lane_ids array<string>, source_ids array<string>",
    "structured": "id string, dossier_id string, standing string, continuity_id string, lane_ids array<string>",
    "admissions": "id string, reference_id string, outcome string, reason string, evidence_digests array<string>",
    "acquisitions": "id string, reference_id string, request_id string, response_digest string, status int",
    "lane_sources": "lane_id string, source_id string",
    "references": "dossier_id string, standing string",
}


def answer_rows():
    return {
        "packets": [["A", "d", "Ann", "first [s1:l1]\n\nsecond\n\nLimits:\n- bounded"]],
        "transactions": [["T", "A", "tx/1", "rp", "f0"]],
        "receipts": [["R", "T", "rp", "f0", True]],
        "claims": [["c1", "A", 1, "first", ["r1", "r2"], ["e1"], ["k1"], "o1", "s1", ["l1"]], ["c2", "A", 2, "second", ["r2"], ["e2"], [], None, "s2", []]],
        "closures": [["x1", "A", "g1", "why", ["c1", "c2"]]],
        "limitations": [["m1", "A", 1, "bounded", ["g2"], []]],
        "gaps": [["g1", "k1", "o1", "s2"], ["g2", None, None, None]],
    }


def dossier_rows():
    return {
        "dossiers": [["D", "dossier/1", "q1", ["close-gap"], ["close-gap"], {"rejected": 1, "supporting-only": 2}, False, False, "none", "none", "none", "none"]],
        "routes": [["W", "D", ["l1", "l2"], ["s1", "s2"]]],
        "structured": [["u1", "D", "rejected", "main", ["l1"]]],
        "admissions": [["M", "u1", "admit", "on-topic", ["d1"]]],
        "acquisitions": [["Q", "u1", "req", "d9", 200]],
        "lane_sources": [["l1", "s1"], ["l2", "s1"], ["l2", "s2"], ["l3", "s9"]],
        "references": [["D", "rejected"], ["D", "supporting-only"], ["D", "supporting-only"]],
    }


def sealed(spark, rows, schemas, tree, ids):
    """Tables with right fingerprints and content-made ids; ids: (table, prefix, parts, tables whose column refers to it), leaves first."""
    rows = {k: [list(r) for r in v] for k, v in rows.items()}
    levels = {level: None for level in schemas}

    def tables(fingerprints):
        out = {}
        for name, schema in schemas.items():
            df = spark.createDataFrame(rows[name], schema)
            kept = fingerprints.get(name, {})
            out[name] = df.withColumn("fingerprint", F.lit(None).cast("string")) if not kept else df.join(spark.createDataFrame(list(kept.items()), "id string, fingerprint string"), "id", "left").select(*df.columns, "fingerprint")
        return out

    deep = lambda: {name: {r.id: r.deep for r in t.collect()} for name, t in hashtree.prints(tree(tables({}))).items()}
    prints = deep()
    for name, prefix, parts, refers in ids:
        columns = [c.strip().split(" ")[0] for c in schemas[name].split(", ")]
        for r in rows[name]:
            text = "|".join([*(str(r[columns.index(p)]) for p in parts), prints[name][r[0]]])
            new = spark.range(1).select(integrity.identity(prefix, F.lit(text)).alias("i")).first().i
            for other, at in refers:
                for o in rows[other]:
                    if o[at] == r[0]:
                        o[at] = new
            prints[name][new] = prints[name].pop(r[0])
            r[0] = new
    return rows, {name: p for name, p in prints.items() if name in levels}, tables


ANSWER_IDS = [("transactions", "transaction", ["review_packet_id", "review_packet_fingerprint"], [("receipts", 1)]), ("packets", "answer", ["dossier_id"], [("transactions", 1), ("claims", 1), ("closures", 1), ("limitations", 1)])]
DOSSIER_IDS = [("admissions", "admission", ["reference_id"], []), ("acquisitions", "acquisition", ["request_id"], []), ("dossiers", "dossier", ["question_id"], [("routes", 1), ("structured", 1), ("references", 0)])]


@pytest.fixture(scope="module")
def answer(spark):
    return sealed(spark, answer_rows(), ANSWER, integrity.answer_tree, ANSWER_IDS)


@pytest.fixture(scope="module")
def dossier(spark):
    return sealed(spark, dossier_rows(), DOSSIER, integrity.dossier_tree, DOSSIER_IDS)


def codes(sealed_, run, *changes):
    rows, prints, tables = sealed_
    old = {k: [list(r) for r in v] for k, v in rows.items()}
    try:
        for name, row, column, value in changes:
            rows[name][row][column] = value
        return {r.code for r in run(tables(prints)).collect()}
    finally:
        rows.update(old)


UP = {"answer-fingerprint", "answer-identity"}
TX = UP | {"transaction-fingerprint", "transaction-identity"}


@pytest.mark.parametrize("changes, expected", [
    ([], set()),
    ([("transactions", 0, 2, "tx/0")], TX | {"transaction-format"}),
    ([("receipts", 0, 3, "f1")], TX | {"reconciliation-receipt-fingerprint", "transaction-packet-parity"}),
    ([("claims", 0, 4, ["r2", "r1"])], UP | {"answer-claim-projection"}),
    ([("claims", 0, 6, [])], UP | {"answer-claim-projection", "gap-closure-candidate"}),
    ([("claims", 0, 7, None)], UP | {"answer-claim-projection", "gap-closure-observation"}),
    ([("closures", 0, 4, ["c1"])], UP | {"gap-closure-projection", "gap-closure-source"}),
    ([("limitations", 0, 3, "other")], UP | {"limitation-projection", "rendered-text"}),
    ([("packets", 0, 3, "")], UP | {"rendered-text"}),
])
def test_answers(answer, changes, expected):
    assert codes(answer, lambda t: integrity.answer_integrity(t, "tx/1"), *changes) == expected


TOP = {"dossier-fingerprint", "dossier-identity"}


@pytest.mark.parametrize("changes, expected", [
    ([], set()),
    ([("dossiers", 0, 1, "x"), ("dossiers", 0, 8, "some")], {"dossier-format", "dossier-authority"}),
    ([("dossiers", 0, 3, [])], TOP | {"next-actions"}),
    ([("references", 0, 1, "deferred")], {"standing-counts"}),
    ([("routes", 0, 3, ["s1"])], TOP | {"route-fingerprint", "route-source-parity"}),
    ([("lane_sources", 3, 0, "l1")], {"route-source-parity"}),
    ([("acquisitions", 0, 4, 404)], TOP | {"structured-acquisition-integrity"}),
    ([("admissions", 0, 3, "off-topic")], TOP | {"structured-admission-fingerprint", "structured-admission-id"}),
])
def test_dossiers(dossier, changes, expected):
    assert codes(dossier, lambda t: integrity.dossier_integrity(t, "dossier/1"), *changes) == expected
