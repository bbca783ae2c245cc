"""Chains of custody: each object keeps the digest of the one it came from, so that a change is found at the link where it happened.

The first part is about any chain of tables: links are sealed level by level, and audited by comparing what a link keeps
with what the link before it is. Each level is one equality join; the table before is written with one row for each id
first, so that a link with a large share of all successors is a hot key that Spark can split.

The second part is the chain of a reviewed acquisition: plan, acquisition receipt, adapter receipt, observation and admission meet
in a review, whose binding is then kept by a packet and its claims. Its rules and codes are fixed values.

Defined cases: nulls differ from empty strings; a link without a link before it has the cause `missing`, and is not taken
to be part of any root; an id that comes twice makes the links after it `ambiguous`; tables may be empty; chains' tables
may have further columns, and so may those of reviews, whose fingerprints cover all other columns of their table; reviews that name an object that does not exist get `review-link-missing` and none of the other codes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.fingerprint import digest
from tarnwick.functions.text import safe_relative
from tarnwick.functions.web import endpoint_allowed
from tarnwick.operators import dossier
from tarnwick.operators.audits import blank, differs, effects, no_digest, no_time, repeats, size
from tarnwick.operators.hashtree import own_text
from tarnwick.operators.integrity import identity
from tarnwick.operators.rules import duplicates, union
from tarnwick.session import materialise

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Link:
    """A table of links: id, prior (the id of the link before, none in the first table), the columns that count,
    kept (the digest of the link before, as kept by this one) and stored (its own digest, as kept)."""

    name: str
    table: DataFrame
    columns: Sequence[str]
    id: str = "id"
    prior: str | None = None
    kept: str = "prior_digest"
    stored: str = "own_digest"


def link_digest(link: Link) -> Column:
    """The digest of a link: its columns and the digest that it keeps of the link before."""
    return F.sha2(F.concat(own_text(link.columns), F.lit("|prior="), F.coalesce(F.col(link.kept), F.lit("-"))), 256)


def seal(links: Sequence[Link]) -> list[Link]:
    """The links with their digests, columns of these names being replaced; of an id that comes twice the least digest is kept."""
    out: list[Link] = []
    for link in links:
        rows = link.table.drop(link.kept, link.stored)
        if link.prior is None:
            rows = rows.withColumn(link.kept, F.lit(None).cast("string"))
        else:
            last = out[-1]
            before = materialise(last.table.groupBy(F.col(last.id).alias("_before")).agg(F.min(last.stored).alias(link.kept)), "links")
            rows = rows.join(before, F.col(link.prior) == F.col("_before"), "left").drop("_before")
        rows = rows.withColumn(link.stored, link_digest(link))
        out.append(replace(link, table=materialise(rows, "sealed")))
    return out


def trace(links: Sequence[Link]) -> dict[str, DataFrame]:
    """For each table (id, root, cause, at_level, at_id, at_cause), ids as text.

    cause is the link's own fault: `own` (changed since it was sealed), `link` (keeps another digest than the link before has: that one was
    replaced), `missing`, `ambiguous`, or null. at_level, at_id and at_cause name the first fault on the way from the root.
    """
    out: dict[str, DataFrame] = {}
    before: DataFrame | None = None
    for link in links:
        text = lambda c: F.col(c).cast("string")
        rows = link.table.select(text(link.id).alias("id"), (text(link.prior) if link.prior else F.lit(None).cast("string")).alias("prior"), F.col(link.kept).alias("kept"), F.col(link.stored).alias("stored"), link_digest(link).alias("now"))
        own = F.when(~F.col("now").eqNullSafe(F.col("stored")), "own")
        first = F.struct(F.lit(link.name).alias("level"), F.col("id"), F.col("cause"))
        if before is None:
            rows = rows.withColumn("cause", own).withColumn("root", F.col("id")).withColumn("at", F.when(F.col("cause").isNotNull(), first))
        else:
            rows = rows.join(before, F.col("prior") == F.col("b_id"), "left")
            cause = F.when(F.col("b_id").isNull(), "missing").when(F.col("b_n") > 1, "ambiguous").when(~F.col("kept").eqNullSafe(F.col("b_stored")), "link").otherwise(own)
            rows = rows.withColumn("cause", cause).withColumn("root", F.col("b_root"))
            rows = rows.withColumn("at", F.coalesce("b_at", F.when(F.col("cause").isNotNull(), first)))
        seen = materialise(rows.select("id", "root", "cause", "at", "stored"), "trace")
        out[link.name] = seen.select("id", "root", "cause", F.col("at.level").alias("at_level"), F.col("at.id").alias("at_id"), F.col("at.cause").alias("at_cause"))
        if link is not links[-1]:
            one = F.min_by(F.struct("root", "at", "stored"), F.struct("stored", "root"))
            one = seen.where("id IS NOT NULL").groupBy(F.col("id").alias("b_id")).agg(F.count("*").alias("b_n"), one.alias("o"))
            before = materialise(one.select("b_id", "b_n", *(F.col(f"o.{c}").alias(f"b_{c}") for c in ("root", "at", "stored"))), "before")
    return out


def chain_findings(links: Sequence[Link], seen: dict[str, DataFrame] | None = None) -> DataFrame:
    """Findings `chain-<cause>` of links with a fault of their own; the detail is the table and the root."""
    seen = trace(links) if seen is None else seen
    faulty = union([seen[k.name].where("cause IS NOT NULL").withColumn("level", F.lit(k.name)) for k in links])
    return faulty.select(F.concat(F.lit("chain-"), "cause").alias("code"), F.lit("error").alias("severity"), F.col("id").alias("subject"), F.concat_ws(" ", "level", "root").alias("detail"))


# Reviewed acquisitions.

SENSITIVE_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key")
HARVEST_MODE = "structured-cache-with-attribution"
ADMITTED, SUPPORTING = "admit-to-review", "supporting-only"
JSON_MEDIA = r"(?i)^application/(?:json|sparql-results\+json)(?:\s*;|$)"
#: Where objects of a review stand: name in the review's row, table, key, the review's column with that key.
PARTS = (("plan", "plans", "request_id", "request_id"), ("receipt", "receipts", "id", "receipt_id"), ("adapter", "adapter_receipts", "id", "adapter_receipt_id"), ("observed", "observations", "id", "observation_id"), ("admission", "admissions", "id", "admission_id"))

#: Adapter: (host, pattern of the path, sources).
Endpoints = dict[str, tuple[str, str, Sequence[str]]]


@dataclass(frozen=True)
class Contract:
    """What a review is held against: formats by table, endpoints by adapter, and the collector's user agent."""

    formats: dict[str, str]
    endpoints: Endpoints
    agent: str


def record_digest(table: DataFrame, *without: str) -> Column:
    """`sha256:` and the digest of a record's columns but these; arrays and maps count as JSON, maps by their keys."""
    flat = {}
    for f in table.schema.fields:
        if f.name not in without:
            kind = f.dataType.typeName()
            c = F.array_sort(F.map_entries(f.name)) if kind == "map" else F.col(f.name)
            flat[f.name] = F.to_json(c) if kind in ("map", "array", "struct") else c
    cells = F.struct(*(c.cast("string").alias(n) for n, c in flat.items()))
    # lengths stand before values, so no value can pass for a part of another
    return digest(F.concat(*(F.concat(F.lit(f"{n}:"), F.coalesce(F.concat(F.length(cells[n]).cast("string"), F.lit(":"), cells[n]), F.lit("-")), F.lit(";")) for n in sorted(flat))))


def receipt_id(request: Column, plan: Column, fingerprint: Column) -> Column:
    return identity("acquisition-receipt", F.concat_ws("|", request, plan, fingerprint))


def _joined(t: Tables) -> DataFrame:
    """Reviews with their objects as structs, null where there is none, and the digests that the objects should have."""
    out = t["reviews"].select("id", "request_id", "receipt_id", "adapter_receipt_id", "observation_id", "admission_id", "receipt_uri", "adapter_receipt_uri")
    for name, table, key, ref in PARTS:
        rows = t[table]
        without = {"receipts": ("fingerprint", "id"), "observations": ()}.get(table, ("fingerprint",))
        one = rows.withColumn("_real", record_digest(rows, *without)).groupBy(F.col(key).alias(f"_{name}_key")).agg(F.min_by(F.struct("*"), "_real").alias(name))
        one = materialise(one, "part")
        out = out.join(one, F.col(ref) == F.col(f"_{name}_key"), "left").drop(f"_{name}_key")
    sources = t["sources"].groupBy(F.col("id").alias("_source")).agg(F.min("harvest_mode").alias("harvest_mode"))
    return materialise(out.join(sources, F.col("plan.source_id") == F.col("_source"), "left").drop("_source"), "reviews")


def _same(*pairs: tuple[str, str]) -> Column:
    """Whether all these columns agree."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _unlike(a: str, b: str) -> Column:
    """Whether two arrays differ as multisets."""
    none = F.array().cast("array<string>")
    return ~F.array_sort(F.coalesce(a, none)).eqNullSafe(F.array_sort(F.coalesce(b, none)))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _each(rows: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Findings by rules (code, what is wrong, subject) in one pass; a condition that is null is none."""
    failed = [F.when(_yes(bad), F.struct(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"))) for code, bad, subject in rules]
    each = rows.select(F.col("id").alias("row"), F.explode(F.filter(F.array(*failed), lambda x: x.isNotNull())).alias("f"))
    return each.select("row", "f.code", F.lit("error").alias("severity"), "f.subject", F.lit("").alias("detail"))


def _plain(found: DataFrame) -> DataFrame:
    return found.drop("row").distinct()


def review_findings(t: Tables, contract: Contract) -> DataFrame:
    """Tables: reviews (id, request_id, receipt_id, adapter_receipt_id, observation_id, admission_id, receipt_uri, adapter_receipt_uri),
    sources (id, harvest_mode), plans (request_id, format, fingerprint, method, record_limit, adapter_id, source_id, url, headers, graph_effect, canon_effect),
    adapter_receipts (id, format, fingerprint, outcome, response_digest, response_bytes, adapter_id, source_id, request_id, record_count, observation_ids,
    candidate_ids, record_ids, graph_effect, canon_effect), receipts (id, format, fingerprint, outcome, raw_retained, adapter_id, source_id, request_id,
    plan_fingerprint, requested_url, final_url, robots_status, robots_digest, http_status, media_type, response_digest, response_bytes, adapter_fingerprint,
    record_count, observation_ids, candidate_ids, request_count, graph_effect, canon_effect), observations (id, source_id, candidate_id, content_digest,
    response_bytes, reviewer_id, receipt_uri) and admissions (id, fingerprint, outcome, source_id, adapter_id, request_id, plan_fingerprint, receipt_id,
    receipt_fingerprint, adapter_fingerprint, observation_id, candidate_id, content_digest, and what `dossier.admission_findings` reads)."""
    found = _plain(_review_findings(t, contract, _joined(t)))
    return union([found, *(duplicates(t[table], key, f"review-{name}-duplicate") for name, table, key, _ in PARTS)])


def _review_findings(t: Tables, contract: Contract, rows: DataFrame) -> DataFrame:
    """Findings with the id of their review as `row`."""
    needed = [name for name, *_ in PARTS if name != "admission"]
    lost = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in needed)), lambda x: x.isNotNull())
    rows = rows.withColumn("lost", lost)
    whole = rows.where(F.size("lost") == 0)
    adapter = F.col("plan.adapter_id")
    at = lambda url: _any((adapter == a) & endpoint_allowed(F.col(url), host, path) for a, (host, path, _) in contract.endpoints.items())
    registered = _any((adapter == a) & F.col("plan.source_id").isin(list(sources)) for a, (_, _, sources) in contract.endpoints.items())
    names = F.transform(F.map_keys("plan.headers"), F.lower)
    agents = F.filter(F.map_entries("plan.headers"), lambda e: F.lower(e["key"]) == "user-agent")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    real_id = receipt_id(F.col("receipt.request_id"), F.col("receipt.plan_fingerprint"), F.col("receipt._real"))
    count = F.col("adapter.record_count")
    parity = (count == size("adapter.observation_ids")) & (count == size("adapter.candidate_ids")) & (count == size("adapter.record_ids"))
    ids_twice = repeats("adapter.observation_ids") | repeats("adapter.candidate_ids") | repeats("adapter.record_ids")
    hit = F.col("receipt.outcome") == "cache-hit"
    admitted = F.col("admission").isNotNull()
    custody = _same(
        ("admission.source_id", "plan.source_id"), ("admission.adapter_id", "plan.adapter_id"), ("admission.request_id", "plan.request_id"),
        ("admission.plan_fingerprint", "plan.fingerprint"), ("admission.receipt_id", "receipt.id"), ("admission.receipt_fingerprint", "receipt.fingerprint"),
        ("admission.adapter_fingerprint", "adapter.fingerprint"), ("admission.observation_id", "observed.id"), ("admission.candidate_id", "observed.candidate_id"),
        ("admission.content_digest", "observed.content_digest"), ("admission.reviewed_by", "observed.reviewer_id"),
    )
    has = lambda ids, one: F.array_contains(F.coalesce(ids, F.array().cast("array<string>")), F.col(one))
    form = lambda part, table: differs(f"{part}.format", F.lit(contract.formats[table]))
    not_positive = lambda c: ~_yes(F.col(c) > 0)
    p, o = "request_id", "observation_id"
    found = _each(whole, [
        ("plan-format", form("plan", "plans"), p), ("plan-fingerprint", differs("plan.fingerprint", "plan._real"), p),
        ("plan-identity", blank("plan.request_id") | differs("plan.method", F.lit("GET")), p),
        ("plan-authority-leak", effects("plan.graph_effect", "plan.canon_effect"), p), ("plan-record-limit", ~_yes(F.col("plan.record_limit").between(1, 500)), p),
        ("adapter-source-registration", ~registered, p), ("source-harvest-contract", differs("harvest_mode", F.lit(HARVEST_MODE)), "plan.source_id"),
        ("plan-endpoint", ~at("plan.url"), p), ("plan-sensitive-header", F.exists(names, lambda n: n.isin(list(SENSITIVE_HEADERS))), p),
        ("plan-multiline-header", F.exists(F.map_values("plan.headers"), lambda v: v.rlike(r"[\r\n]")), p),
        ("plan-user-agent", ~_yes(F.get(agents, F.size(agents) - 1)["value"] == contract.agent), p),
        ("adapter-receipt-format", form("adapter", "adapter_receipts"), p), ("adapter-receipt-fingerprint", differs("adapter.fingerprint", "adapter._real"), p),
        ("adapter-outcome", ~_yes(F.col("adapter.outcome").isin("observed", "partial")), p), ("adapter-authority-leak", effects("adapter.graph_effect", "adapter.canon_effect"), p),
        ("adapter-source-response", no_digest("adapter.response_digest") | not_positive("adapter.response_bytes"), p),
        ("adapter-plan-mismatch", ~_same(("adapter.adapter_id", "plan.adapter_id"), ("adapter.source_id", "plan.source_id"), ("adapter.request_id", "plan.request_id")), p),
        ("adapter-record-parity", ~_yes(parity) | ids_twice, p),
        ("acquisition-receipt-format", form("receipt", "receipts"), p), ("acquisition-receipt-fingerprint", differs("receipt.fingerprint", "receipt._real"), p),
        ("acquisition-receipt-identity", differs(F.col("receipt.id"), real_id), p), ("acquisition-outcome", ~_yes(F.col("receipt.outcome").isin("observed", "partial", "cache-hit")), p),
        ("raw-response-retention", differs("receipt.raw_retained", F.lit(False)), p), ("acquisition-authority-leak", effects("receipt.graph_effect", "receipt.canon_effect"), p),
        ("acquisition-plan-mismatch", ~_same(("receipt.adapter_id", "plan.adapter_id"), ("receipt.source_id", "plan.source_id"), ("receipt.request_id", "plan.request_id"), ("receipt.plan_fingerprint", "plan.fingerprint"), ("receipt.requested_url", "plan.url")), p),
        ("acquisition-final-endpoint", ~at("receipt.final_url"), p), ("acquisition-robots", ~_yes(F.col("receipt.robots_status").isin("allowed", "absent")), p),
        ("acquisition-robots-digest", F.col("receipt.robots_digest").isNotNull() & no_digest("receipt.robots_digest"), p),
        ("acquisition-http-result", ~_yes(F.col("receipt.http_status").between(200, 299) & F.col("receipt.media_type").rlike(JSON_MEDIA)), p),
        ("raw-response-custody", no_digest("receipt.response_digest") | not_positive("receipt.response_bytes") | ~_same(("receipt.response_digest", "adapter.response_digest"), ("receipt.response_bytes", "adapter.response_bytes")), p),
        ("adapter-acquisition-fingerprint", differs("receipt.adapter_fingerprint", "adapter.fingerprint"), p),
        ("acquisition-adapter-parity", differs("receipt.record_count", "adapter.record_count") | _unlike("receipt.observation_ids", "adapter.observation_ids") | _unlike("receipt.candidate_ids", "adapter.candidate_ids"), p),
        ("acquisition-request-count", ~_yes(F.when(_yes(hit), F.col("receipt.request_count") == 0).otherwise(F.col("receipt.request_count") > 0)), p),
        ("reviewed-observation-parity", differs("observed.source_id", "plan.source_id") | ~_yes(has(F.col("receipt.observation_ids"), "observed.id")) | ~_yes(has(F.col("receipt.candidate_ids"), "observed.candidate_id")), o),
        ("normalized-observation-custody", no_digest("observed.content_digest") | not_positive("observed.response_bytes"), o),
        ("admission-missing", ~admitted, o), ("observation-not-admitted", admitted & differs("admission.outcome", F.lit(ADMITTED)), "admission_id"),
        ("admission-custody-parity", admitted & ~custody, "admission_id"),
        ("admission-fingerprint", admitted & differs("admission.fingerprint", "admission._real"), "admission_id"),
        ("unsafe-receipt-uri", ~_yes(safe_relative(text("receipt_uri")) & safe_relative(text("adapter_receipt_uri")) & safe_relative(text("observed.receipt_uri"))), o),
    ])
    given = whole.select(F.col("id").alias("row"), F.col("admission_id").alias("subject")).where("subject IS NOT NULL")
    admissions = dossier.admission_findings(t["admissions"].withColumnRenamed("id", "admission_id"))
    admissions = given.join(admissions, "subject").select("row", "code", "severity", "subject", "detail")
    missing = rows.where(F.size("lost") > 0)
    missing = missing.select(F.col("id").alias("row"), F.lit("review-link-missing").alias("code"), F.lit("error").alias("severity"), F.col("id").cast("string").alias("subject"), F.array_join("lost", ", ").alias("detail"))
    return union([found, admissions, missing])


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | _yes(c)
    return out


#: What a binding takes from its review: column, where it stands.
BOUND = (
    ("source_id", "plan.source_id"), ("adapter_id", "plan.adapter_id"), ("request_id", "plan.request_id"), ("plan_fingerprint", "plan.fingerprint"), ("requested_url", "plan.url"),
    ("final_url", "receipt.final_url"), ("receipt_id", "receipt.id"), ("receipt_fingerprint", "receipt.fingerprint"), ("receipt_uri", "receipt_uri"),
    ("adapter_fingerprint", "adapter.fingerprint"), ("adapter_receipt_uri", "adapter_receipt_uri"), ("response_digest", "receipt.response_digest"), ("response_bytes", "receipt.response_bytes"),
    ("observation_id", "observed.id"), ("candidate_id", "observed.candidate_id"), ("content_digest", "observed.content_digest"), ("admission_id", "admission.id"),
    ("admission_fingerprint", "admission.fingerprint"), ("admission_outcome", "admission.outcome"), ("admission_reason", "admission.reason"), ("reviewed_by", "admission.reviewed_by"),
    ("reviewed_at", "admission.reviewed_at"), ("lanes", "admission.lanes"), ("robots_status", "receipt.robots_status"), ("http_status", "receipt.http_status"), ("acquisition_outcome", "receipt.outcome"),
)


def bindings(t: Tables, contract: Contract, form: str) -> DataFrame:
    """A binding (id of the review, format, BOUND, raw_retained, authority_role, effects, fingerprint) for each review without findings of its own."""
    rows = _joined(t)
    bad = materialise(_review_findings(t, contract, rows).select("row").distinct(), "bad")
    rows = rows.join(bad, F.col("id") == F.col("row"), "left_anti")
    none = F.lit("none")
    out = rows.select("id", F.lit(form).alias("format"), *(F.col(at).alias(c) for c, at in BOUND), F.lit(False).alias("raw_retained"), F.lit(SUPPORTING).alias("authority_role"), none.alias("graph_effect"), none.alias("canon_effect"))
    return out.withColumn("fingerprint", record_digest(out))


def binding_findings(rows: DataFrame, form: str) -> DataFrame:
    """Findings of bindings by themselves."""
    digests = F.lit(False)
    for c in ("plan_fingerprint", "receipt_fingerprint", "adapter_fingerprint", "response_digest", "content_digest", "admission_fingerprint"):
        digests = digests | no_digest(c)
    reasons = list(dossier.ADMISSION[ADMITTED][1])
    beyond = differs("raw_retained", F.lit(False)) | differs("authority_role", F.lit(SUPPORTING)) | differs("admission_outcome", F.lit(ADMITTED)) | ~_yes(F.col("admission_reason").isin(reasons))
    beyond = beyond | blank("reviewed_by") | no_time("reviewed_at") | (size("lanes") == 0) | effects("graph_effect", "canon_effect")
    real = rows.withColumn("_real", record_digest(rows, "fingerprint"))
    return _plain(_each(real, [("binding-format", differs("format", F.lit(form)), "request_id"), ("binding-fingerprint", differs("fingerprint", "_real"), "request_id"), ("binding-digest", digests, "request_id"), ("binding-authority", beyond, "request_id")]))


#: What a packet's observation and its claims keep of a binding: own column, the binding's.
IN_PACKET = (("source_id", "source_id"), ("observation_id", "observation_id"), ("candidate_id", "candidate_id"), ("content_digest", "content_digest"))
IN_OBSERVATION = (("binding_fingerprint", "fingerprint"), ("receipt_id", "receipt_id"), ("receipt_fingerprint", "receipt_fingerprint"), ("adapter_fingerprint", "adapter_fingerprint"), ("admission_id", "admission_id"), ("admission_fingerprint", "admission_fingerprint"), ("admission_outcome", "admission_outcome"))
IN_CLAIM = (("binding_fingerprint", "fingerprint"), ("response_digest", "response_digest"), ("content_digest", "content_digest"), ("raw_retained", "raw_retained"), ("admission_id", "admission_id"), ("admission_fingerprint", "admission_fingerprint"), ("admission_outcome", "admission_outcome"))


def bind(rows: DataFrame, bound: DataFrame, columns: Sequence[tuple[str, str]], ref: str = "binding_id") -> DataFrame:
    """rows with what they have to keep of their binding."""
    b = bound.select(F.col("id").alias("_b"), *(F.col(theirs).alias(f"_n_{own}") for own, theirs in columns))
    joined = rows.drop(*(own for own, _ in columns)).join(b, F.col(ref) == F.col("_b"), "left").drop("_b")
    return joined.withColumnsRenamed({f"_n_{own}": own for own, _ in columns})


def packet_findings(packets: DataFrame, claims: DataFrame, bound: DataFrame, form: str) -> DataFrame:
    """Findings of packets (id, binding_id, IN_PACKET, IN_OBSERVATION) and claims (id, packet_id, authority_role, IN_CLAIM) against their bindings, and of these.
    A packet whose binding does not exist keeps nothing right."""
    one = materialise(bound.groupBy(F.col("id").alias("_b")).agg(F.min_by(F.struct("*"), "fingerprint").alias("b")), "bound")
    of = packets.join(one, F.col("binding_id") == F.col("_b"), "left")
    wrong = lambda own, pairs: ~_same(*((f"{own}{a}", f"b.{b}") for a, b in pairs)) | F.col("b").isNull()
    refused = differs("admission_outcome", F.lit(ADMITTED))
    found = _each(of, [("packet-binding-parity", wrong("", IN_PACKET), "id"), ("packet-observation-binding", wrong("", IN_OBSERVATION) | refused, "id")])
    by_packet = materialise(packets.groupBy(F.col("id").alias("_p")).agg(F.min("binding_id").alias("_binding")), "packets")
    said = claims.join(by_packet, F.col("packet_id") == F.col("_p"), "left").join(one, F.col("_binding") == F.col("_b"), "left")
    claimed = _each(said, [("claim-binding-parity", wrong("", IN_CLAIM) | refused | differs("authority_role", F.lit("supporting")) | differs("raw_retained", F.lit(False)), "id")])
    return union([_plain(found), _plain(claimed), binding_findings(bound, form)])
