"""Chains and reviews that are whole give no finding; each planted fault gives its code, where it was planted."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import custody
from tarnwick.operators.custody import Link

SHA = "sha256:" + "a" * 64


def chain(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "")], "id long, v string")
    b = spark.createDataFrame([(i, i % 3 + 1, "b") for i in range(12)], "id long, up long, v string")
    c = spark.createDataFrame([(i, i % 12, "c") for i in range(100)], "id long, up long, v string")
    return custody.seal([Link("a", a, ["v"]), Link("b", b, ["v"], prior="up"), Link("c", c, ["v"], prior="up")])


def test_a_whole_chain_has_no_findings(spark):
    links = chain(spark)
    assert custody.chain_findings(links).count() == 0
    seen = custody.trace(links)["c"]
    assert sorted((r.id, r.root) for r in seen.collect()) == sorted((str(i), str(i % 12 % 3 + 1)) for i in range(100))
    empty = [dataclasses.replace(k, table=k.table.limit(0)) for k in links]
    assert custody.chain_findings(empty).count() == 0


def test_faults_are_found_at_their_link(spark):
    a, b, c = chain(spark)
    changed = b.table.withColumn("v", F.when(F.col("id") == 4, "other").otherwise(F.col("v")))
    resealed = changed.withColumn("v", F.when(F.col("id") == 5, None).otherwise(F.col("v"))).withColumn("own_digest", F.when(F.col("id") == 5, custody.link_digest(b)).otherwise(F.col("own_digest")))
    twice = resealed.where("id <> 6").unionByName(resealed.where("id = 7"))
    links = [a, dataclasses.replace(b, table=twice), c]
    found = {tuple(r) for r in custody.chain_findings(links).select("code", "subject", "detail").collect()}
    at = lambda k: [i for i in range(100) if i % 12 == k]
    want = {("chain-own", "4", "b 2")} | {("chain-link", str(i), "c 3") for i in at(5)} | {("chain-missing", str(i), "c") for i in at(6)} | {("chain-ambiguous", str(i), "c 2") for i in at(7)}
    assert found == want
    reached = {r.id: (r.at_level, r.at_id, r.at_cause) for r in custody.trace(links)["c"].where("at_level IS NOT NULL").collect()}
    assert {i for i, x in reached.items() if x == ("b", "4", "own")} == {str(i) for i in at(4)} and len(reached) == sum(len(at(k)) for k in (4, 5, 6, 7))


CONTRACT = custody.Contract({"plans": "plan/1", "receipts": "receipt/1", "adapter_receipts": "adapter/1"}, {"works": ("api.example.org", "^/works", ["s1"])}, "collector/1")
COLUMNS = {
    "plans": "request_id string, format string, method string, record_limit int, adapter_id string, source_id string, url string, headers map<string,string>, graph_effect string, canon_effect string, fingerprint string",
    "adapter_receipts": "id string, format string, outcome string, response_digest string, response_bytes long, adapter_id string, source_id string, request_id string, record_count int, observation_ids array<string>, candidate_ids array<string>, record_ids array<string>, graph_effect string, canon_effect string, fingerprint string",
    "receipts": "id string, format string, outcome string, raw_retained boolean, adapter_id string, source_id string, request_id string, plan_fingerprint string, requested_url string, final_url string, robots_status string, robots_digest string, http_status int, media_type string, response_digest string, response_bytes long, adapter_fingerprint string, record_count int, observation_ids array<string>, candidate_ids array<string>, request_count int, graph_effect string, canon_effect string, fingerprint string",
    "observations": "id string, source_id string, candidate_id string, content_digest string, response_bytes long, reviewer_id string, receipt_uri string",
    "admissions": "id string, outcome string, reason string, rationale string, reviewed_by string, reviewed_at string, lanes array<string>, digests array<string>, evidence array<struct<effect:string,value:string,note:string>>, source_id string, adapter_id string, request_id string, plan_fingerprint string, receipt_id string, receipt_fingerprint string, adapter_fingerprint string, observation_id string, candidate_id string, content_digest string, fingerprint string",
    "reviews": "id string, request_id string, receipt_id string, adapter_receipt_id string, observation_id string, admission_id string, receipt_uri string, adapter_receipt_uri string",
}
NONE = {"graph_effect": "none", "canon_effect": "none"}
AGENT = {"User-Agent": "collector/1", "accept": "application/json"}
P, A, R, O, M, V = "plans", "adapter_receipts", "receipts", "observations", "admissions", "reviews"
#: code: (table, changes, whether they come after fingerprints are made)
FAULTS = {
    "plan-format": (P, {"format": "plan/0"}, False), "plan-fingerprint": (P, {"record_limit": 9}, True), "plan-identity": (P, {"method": "POST"}, False),
    "plan-authority-leak": (P, {"graph_effect": "node"}, False), "plan-record-limit": (P, {"record_limit": 501}, False), "adapter-source-registration": (P, {"source_id": "s2"}, False),
    "source-harvest-contract": (P, {"source_id": "s3"}, False), "plan-endpoint": (P, {"url": "http://api.example.org/works"}, False), "plan-sensitive-header": (P, {"headers": {**AGENT, "Cookie": "x"}}, False),
    "plan-multiline-header": (P, {"headers": {**AGENT, "accept": "a\nb"}}, False), "plan-user-agent": (P, {"headers": {"accept": "x"}}, False),
    "adapter-receipt-format": (A, {"format": None}, False), "adapter-receipt-fingerprint": (A, {"fingerprint": None}, True), "adapter-outcome": (A, {"outcome": "refused"}, False),
    "adapter-authority-leak": (A, {"canon_effect": None}, False), "adapter-source-response": (A, {"response_bytes": 0}, False), "adapter-plan-mismatch": (A, {"request_id": "other"}, False),
    "adapter-record-parity": (A, {"record_ids": ["r", "r"]}, False), "acquisition-receipt-format": (R, {"format": ""}, False), "acquisition-receipt-fingerprint": (R, {"fingerprint": SHA}, True),
    "acquisition-receipt-identity": (R, {"id": "made-up"}, True), "acquisition-outcome": (R, {"outcome": "error"}, False), "raw-response-retention": (R, {"raw_retained": None}, False),
    "acquisition-authority-leak": (R, {"graph_effect": "edge"}, False), "acquisition-plan-mismatch": (R, {"requested_url": "https://api.example.org/works/2"}, False), "acquisition-final-endpoint": (R, {"final_url": None}, False),
    "acquisition-robots": (R, {"robots_status": "denied"}, False), "acquisition-robots-digest": (R, {"robots_digest": "md5:1"}, False), "acquisition-http-result": (R, {"media_type": "text/html"}, False),
    "raw-response-custody": (R, {"response_bytes": 8}, False), "adapter-acquisition-fingerprint": (R, {"adapter_fingerprint": SHA}, False), "acquisition-adapter-parity": (R, {"record_count": 3}, False),
    "acquisition-request-count": (R, {"request_count": 0}, False), "reviewed-observation-parity": (O, {"source_id": None}, False), "normalized-observation-custody": (O, {"response_bytes": None}, False),
    "admission-missing": (V, {"admission_id": None}, False), "observation-not-admitted": (M, {"outcome": "reject-off-topic", "reason": "off-topic-query-collision"}, False), "admission-custody-parity": (M, {"reviewed_by": "Bob"}, False),
    "admission-fingerprint": (M, {"fingerprint": "x"}, True), "admission-rationale": (M, {"rationale": "short"}, False), "unsafe-receipt-uri": (V, {"receipt_uri": "../up.json"}, False), "review-link-missing": (V, {"adapter_receipt_id": "nowhere"}, False),
}


@pytest.fixture(scope="module")
def estate(spark):
    names = ["whole", *FAULTS]

    def made(table, rows, without=("fingerprint",)):
        """Rows as a frame with fingerprints, faults of this table planted before or after; and the rows as dicts by review."""
        cols = [c.strip().split(" ")[0] for c in COLUMNS[table].split(", ") if " " in c.strip()]
        for n, r in rows.items():
            if n in FAULTS and FAULTS[n][0] == table and not FAULTS[n][2]:
                r.update(FAULTS[n][1])
        frame = spark.createDataFrame([(n, *(r.get(c) for c in cols)) for n, r in rows.items()], "_n string, " + COLUMNS[table])
        if "fingerprint" in cols:
            prints = dict(map(tuple, frame.select("_n", custody.record_digest(frame.drop("_n"), *without)).collect()))
            for n, r in rows.items():
                r["fingerprint"] = prints[n]
        return cols, rows

    def late(table, cols, rows):
        for n, r in rows.items():
            if n in FAULTS and FAULTS[n][0] == table and FAULTS[n][2]:
                r.update(FAULTS[n][1])
        return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows.values()], COLUMNS[table])

    url = "https://api.example.org/works/1"
    pc, plans = made(P, {n: {"request_id": f"q-{n}", "format": "plan/1", "method": "GET", "record_limit": 10, "adapter_id": "works", "source_id": "s1", "url": url, "headers": AGENT, **NONE} for n in names})
    ids = lambda n: {"observation_ids": [f"o-{n}", "o2"], "candidate_ids": ["c2", f"c-{n}"]}
    ac, adapters = made(A, {n: {"id": f"a-{n}", "format": "adapter/1", "outcome": "observed", "response_digest": SHA, "response_bytes": 7, "adapter_id": "works", "source_id": plans[n]["source_id"], "request_id": f"q-{n}", "record_count": 2, **ids(n), "record_ids": ["r1", "r2"], **NONE} for n in names})
    rc, receipts = made(R, {n: {"format": "receipt/1", "outcome": "observed", "raw_retained": False, "adapter_id": "works", "source_id": plans[n]["source_id"], "request_id": f"q-{n}", "plan_fingerprint": plans[n]["fingerprint"], "requested_url": plans[n]["url"], "final_url": url, "robots_status": "absent", "http_status": 200, "media_type": "application/json; charset=utf-8", "response_digest": SHA, "response_bytes": adapters[n]["response_bytes"], "adapter_fingerprint": adapters[n]["fingerprint"], "record_count": 2, **ids(n), "request_count": 1, **NONE} for n in names}, ("fingerprint", "id"))
    given = spark.createDataFrame([(n, r["request_id"], r["plan_fingerprint"], r["fingerprint"]) for n, r in receipts.items()], "n string, q string, p string, f string")
    for n, i in given.select("n", custody.receipt_id(F.col("q"), F.col("p"), F.col("f"))).collect():
        receipts[n]["id"] = i
    late_receipts = late(R, rc, receipts)
    oc, seen = made(O, {n: {"id": f"o-{n}", "source_id": plans[n]["source_id"], "candidate_id": f"c-{n}", "content_digest": SHA, "response_bytes": 5, "reviewer_id": "Ann", "receipt_uri": "r/1.json"} for n in names})
    evidence = [("supports-admission", "v", "n"), ("supports-rejection", "v", "n")]
    mc, admitted = made(M, {n: {"id": f"m-{n}", "outcome": "admit-to-review", "reason": "bounded-relevant-metadata", "rationale": "says what it is about at some length", "reviewed_by": "Ann", "reviewed_at": "2024-01-02T00:00:00Z", "lanes": ["l"], "digests": [SHA], "evidence": evidence, "source_id": plans[n]["source_id"], "adapter_id": "works", "request_id": f"q-{n}", "plan_fingerprint": plans[n]["fingerprint"], "receipt_id": receipts[n]["id"], "receipt_fingerprint": receipts[n]["fingerprint"], "adapter_fingerprint": adapters[n]["fingerprint"], "observation_id": f"o-{n}", "candidate_id": f"c-{n}", "content_digest": SHA} for n in names})
    vc, reviews = made(V, {n: {"id": n, "request_id": f"q-{n}", "receipt_id": receipts[n]["id"], "adapter_receipt_id": f"a-{n}", "observation_id": f"o-{n}", "admission_id": f"m-{n}", "receipt_uri": "r/2.json", "adapter_receipt_uri": "r/3.json"} for n in names})
    sources = spark.createDataFrame([(s, custody.HARVEST_MODE) for s in ("s1", "s2")], "id string, harvest_mode string")
    frames = {P: late(P, pc, plans), A: late(A, ac, adapters), R: late_receipts, O: late(O, oc, seen), M: late(M, mc, admitted), V: late(V, vc, reviews), "sources": sources}
    return frames


def test_each_fault_gives_its_code(spark, estate):
    rows = custody._joined(estate)
    found = {}
    for r in custody._review_findings(estate, CONTRACT, rows).collect():
        found.setdefault(r.row, set()).add(r.code)
    assert "whole" not in found
    assert {n for n in FAULTS if n not in found.get(n, ())} == set()
    # a fault shows where its object is compared, and nowhere else
    follow = {"adapter-source-registration", "source-harvest-contract", "admission-custody-parity", "adapter-acquisition-fingerprint", "acquisition-plan-mismatch", "raw-response-custody", "acquisition-adapter-parity", "plan-fingerprint", "adapter-receipt-fingerprint", "acquisition-receipt-identity", "plan-endpoint"}
    assert {n: codes - {n} - follow for n, codes in found.items() if codes - {n} - follow} == {}
    plain = custody.review_findings(estate, CONTRACT).select("code", "subject")
    assert plain.count() == plain.distinct().count() and plain.where("subject = 'q-whole' OR subject = 'o-whole'").count() == 0


def test_bindings_packets_and_claims(spark, estate):
    bound = custody.bindings(estate, CONTRACT, "binding/1")
    assert [r.id for r in bound.select("id").collect()] == ["whole"]
    packets = custody.bind(custody.bind(spark.createDataFrame([("k1", "whole")], "id string, binding_id string"), bound, custody.IN_PACKET), bound, custody.IN_OBSERVATION)
    claims = custody.bind(spark.createDataFrame([("c1", "k1", "supporting", "whole"), ("c2", "k1", "supporting", "whole")], "id string, packet_id string, authority_role string, binding_id string"), bound, custody.IN_CLAIM)
    codes = lambda p, c, b: {(r.code, r.subject) for r in custody.packet_findings(p, c, b, "binding/1").collect()}
    assert codes(packets, claims, bound) == set()
    assert codes(packets.withColumn("candidate_id", F.lit(None).cast("string")), claims, bound) == {("packet-binding-parity", "k1")}
    assert codes(packets.withColumn("receipt_id", F.lit("x")), claims.withColumn("raw_retained", F.col("id") == "c2"), bound) == {("packet-observation-binding", "k1"), ("claim-binding-parity", "c2")}
    q = "q-whole"
    assert codes(packets, claims, bound.withColumn("format", F.lit("binding/0"))) == {("binding-format", q), ("binding-fingerprint", q)}
    assert codes(packets, claims, bound.withColumn("plan_fingerprint", F.lit("x"))) == {("binding-digest", q), ("binding-fingerprint", q)}
    assert codes(packets, claims, bound.withColumn("authority_role", F.lit("primary"))) == {("binding-authority", q), ("binding-fingerprint", q)}
    assert codes(packets, claims, bound.limit(0)) == {("packet-binding-parity", "k1"), ("packet-observation-binding", "k1"), ("claim-binding-parity", "c1"), ("claim-binding-parity", "c2")}


def test_empty_estate(spark, estate):
    none = {k: v.limit(0) for k, v in estate.items()}
    assert custody.review_findings(none, CONTRACT).count() == 0 and custody.bindings(none, CONTRACT, "b").count() == 0
