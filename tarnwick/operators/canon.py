"""Constraint compiler: an ordered, transactional fold of events over scoped state.

A branch is one row (branch_id, bible, decisions, extra_events), JSON texts; branches are folded
independently, so proposals spread over the cluster while each fold, which is sequential by nature,
stays in one place. The state is a small object of sets and maps with an undo log: an event changes it in
place, and what it has changed is put back if a rule finds an error. Rules over the whole state (exclusive groups, bounds,
lost carriers) are kept up by what an event touches, so a fold takes steps in proportion to its events' own sizes.
`tarnwick.streaming.branches` folds the same rules over events that come as rows, with the state kept by key.
"""

from __future__ import annotations

import json
import math
import operator
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
ORDER = {"error": 0, "warning": 1, "notice": 2}
Finding = tuple[str, str, str, str]  # code, severity, subject, detail
ABSENT = object()


@dataclass
class State:
    entities: set[str] = field(default_factory=set)
    propositions: set[str] = field(default_factory=set)
    knowledge: set[tuple[str, str]] = field(default_factory=set)
    capabilities: set[tuple[str, str]] = field(default_factory=set)
    variables: dict[str, float] = field(default_factory=dict)
    places: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    resolved: set[str] = field(default_factory=set)
    fulfilled: dict[str, tuple[str, int]] = field(default_factory=dict)
    done: set[str] = field(default_factory=set)
    #: What has been changed since the last commit: (field, key, the old value or ABSENT).
    log: list[tuple[str, object, object]] = field(default_factory=list)

    def put(self, kind: str, key, value=True) -> None:
        held = getattr(self, kind)
        if isinstance(held, set):
            if key not in held:
                self.log.append((kind, key, ABSENT))
                held.add(key)
        else:
            self.log.append((kind, key, held.get(key, ABSENT)))
            held[key] = value

    def drop(self, kind: str, key) -> None:
        held = getattr(self, kind)
        if key in held:
            self.log.append((kind, key, True if isinstance(held, set) else held[key]))
            held.discard(key) if isinstance(held, set) else held.pop(key)

    def undo(self) -> None:
        """Put back what has been changed since the last commit, last changes first."""
        for kind, key, old in reversed(self.log):
            held = getattr(self, kind)
            if isinstance(held, set):
                held.discard(key) if old is ABSENT else held.add(key)
            elif old is ABSENT:
                held.pop(key, None)
            else:
                held[key] = old
        self.log.clear()


def scope(bible: dict, target: str) -> set[str]:
    """The continuities that a target inherits from, itself included; unknown ones are skipped."""
    parents = {c["id"]: c.get("inheritsFromIds", []) for c in bible.get("continuities", [])}
    seen, todo = set(), [target]
    while todo:
        c = todo.pop()
        if c in parents and c not in seen:
            seen.add(c)
            todo += parents[c]
    return seen


def travel_time(start: str, end: str, edges: Iterable[dict], held: set[str]) -> float | None:
    """Least duration over edges whose needs are held; None if there is no way."""
    out = defaultdict(list)
    for e in edges:
        if held.issuperset(e.get("requiredCapabilityIds", [])):
            out[e["fromLocationId"]].append((e["toLocationId"], e["minimumDuration"]))
    heap, best = [(0, start)], {start: 0}
    while heap:
        far, at = heappop(heap)
        if at == end:
            return far
        if far > best[at]:
            continue
        for to, t in out[at]:
            if far + t < best.get(to, math.inf):
                best[to] = far + t
                heappush(heap, (far + t, to))
    return None


class Branch:
    """One bible under one set of decisions."""

    def __init__(self, bible: dict, decisions: dict, extra: Iterable[dict] = ()) -> None:
        """Extra events are proposals: they count as enabled."""
        self.bible, self.decisions = bible, decisions
        extra = [{**e, "enabledByDefault": True} for e in extra]
        inside = self.inside = scope(bible, decisions["targetContinuityId"])
        mine = lambda key, more=(): {x["id"]: x for x in [*bible.get(key, []), *more] if inside & set(x.get("continuityIds", []))}
        self.propositions, self.variables, self.functions, self.endpoints = (mine(k) for k in ("propositions", "stateVariables", "narrativeFunctions", "endpoints"))
        self.eligible = {"entities": set(mine("entities")), "capabilities": set(mine("capabilities"))}
        self.edges = [e for e in bible.get("travelEdges", []) if inside & set(e.get("continuityIds", []))]
        self.scoped_events = mine("events", extra)
        self.events = {x["id"]: x for x in [*bible.get("events", []), *extra]}
        options = {o["id"]: o for o in bible.get("variantOptions", [])}
        self.options = [options[o] for o in sorted(decisions.get("selectedOptionIds", [])) if o in options]
        self.findings: list[Finding] = []
        self.retired: set[str] = set()
        self.carriers: dict[str, list[str]] = {}
        self.last = 0
        self.groups: dict[str, set[str]] = defaultdict(set)
        self.clashing: set[str] = set()
        self.broken: dict[str, tuple[str, str]] = {}
        self.by_carrier: dict[str, list[str]] = defaultdict(list)
        self.lost: dict[str, list[str]] = {}
        self.state = self._initial()
        self.active_events = self._active_events()
        self.active_ids = {e["id"] for e in self.active_events}

    def _effects(self, key: str) -> Iterator:
        for o in self.options:
            yield from o["effects"].get(key, [])

    # Layers: defaults, initial state, options, decisions.

    def _initial(self) -> State:
        start, d, s = self.bible.get("initialState", {}), self.decisions, State()
        known = start.get("activeEntityIds")
        s.entities = self.eligible["entities"] & set(known) if known is not None else set(self.eligible["entities"])
        s.entities -= set(self._effects("removeEntityIds"))
        on = {p for p, x in self.propositions.items() if x.get("enabledByDefault")} | set(start.get("activePropositionIds", []))
        for o in self.options:
            on |= set(o["effects"].get("activatePropositionIds", []))
            on -= set(o["effects"].get("deactivatePropositionIds", []))
        on = (on | set(d.get("assumePropositionIds", []))) - set(d.get("excludePropositionIds", []))
        s.propositions = on & set(self.propositions)
        self._refresh(s, [("propositions", p) for p in s.propositions])
        self.findings += self._exclusive(d["id"])
        s.variables = {v: x["initialValue"] for v, x in self.variables.items()}
        by_var = defaultdict(set)
        for o in self._effects("variableOverrides"):
            by_var[o["variableId"]].add(o["value"])
        for v, values in sorted(by_var.items()):
            if len(values) > 1:
                self.findings.append(("conflicting-variable-override", "error", v, "selected options assign different values"))
            elif v in s.variables:
                s.variables[v] = next(iter(values))
        s.variables |= {o["variableId"]: o["value"] for o in d.get("variableOverrides", []) if o["variableId"] in s.variables}
        self._refresh(s, [("variables", v) for v in s.variables])
        self.findings += self._bounds(d["id"])
        self._assign(s)
        for f, own in self.carriers.items():
            for c in set(own):
                self.by_carrier[c].append(f)
        s.knowledge = {(k["actorId"], k["propositionId"]) for k in start.get("knowledge", []) if k["actorId"] in s.entities and k["propositionId"] in self.propositions}
        s.capabilities = {(k["entityId"], k["capabilityId"]) for k in start.get("capabilities", []) if k["entityId"] in s.entities and k["capabilityId"] in self.eligible["capabilities"]}
        s.places = {p["entityId"]: (p["locationId"], p["time"]["earliest"], p["time"]["latest"]) for p in start.get("entityLocations", []) if p["entityId"] in s.entities}
        return s

    def _assign(self, s: State) -> None:
        start, d = self.bible.get("initialState", {}), self.decisions
        layers = {f: x["defaultCarrierIds"] for f, x in self.functions.items() if x.get("defaultCarrierIds")}
        layers |= {a["functionId"]: a["carrierIds"] for a in start.get("functionAssignments", []) if a["functionId"] in self.functions}
        wanted = defaultdict(list)
        for a in self._effects("functionAssignments"):
            wanted[a["functionId"]].append(a["carrierIds"])
        for f, lists in sorted(wanted.items()):
            if len({tuple(sorted(x)) for x in lists}) > 1:
                self.findings.append(("conflicting-function-assignment", "error", f, "selected options assign different carriers"))
            else:
                layers[f] = lists[0]
        layers |= {a["functionId"]: a["carrierIds"] for a in d.get("functionAssignments", []) if a["functionId"] in self.functions}
        self.retired = set(self._effects("retireFunctionIds")) | {r["functionId"] for r in d.get("functionRetirements", [])}
        for f in sorted(self.retired):
            layers.pop(f, None)
            if self.functions.get(f, {}).get("required"):
                self.findings.append(("required-function-retired", "error", f, "a required function is retired"))
        for f, x in sorted(self.functions.items()):
            if f in self.retired:
                continue
            grave = "error" if x.get("required") else "warning"
            if f not in layers:
                self.findings.append(("orphaned-function", grave, f, "no carrier is assigned"))
                continue
            live = [c for c in layers[f] if c in s.entities]
            if len(live) < len(layers[f]):
                gone = ", ".join(sorted(set(layers[f]) - s.entities))
                self.findings.append(("removed-function-carrier", "warning" if live else grave, f, f"inactive: {gone}"))
            if live:
                self.carriers[f] = live
            else:
                self.findings.append(("orphaned-function", grave, f, "all carriers are inactive"))

    def _active_events(self) -> list[dict]:
        on = {e for e, x in self.scoped_events.items() if x.get("enabledByDefault")}
        for o in self.options:
            on |= set(o["effects"].get("activateEventIds", [])) & set(self.scoped_events)
            on -= set(o["effects"].get("deactivateEventIds", []))
        return sorted((self.scoped_events[e] for e in on), key=lambda e: (e["sequence"], e["id"]))

    # Rules over a state.

    def _refresh(self, s: State, touched: Iterable[tuple]) -> None:
        """Keep up what is wrong with the state as a whole, after these (field, key) have changed."""
        for kind, key, *_ in touched:
            if kind == "propositions" and key in self.propositions and (g := self.propositions[key].get("exclusiveGroupId")):
                self.groups[g].add(key) if key in s.propositions else self.groups[g].discard(key)
                self.clashing.add(g) if len(self.groups[g]) > 1 else self.clashing.discard(g)
            elif kind == "variables" and key in self.variables:
                found = self._out_of_bounds(self.variables[key], s.variables.get(key))
                if found:
                    self.broken[key] = found
                else:
                    self.broken.pop(key, None)
            elif kind == "entities":
                for f in self.by_carrier.get(key, ()):
                    gone = sorted(set(self.carriers[f]) - s.entities)
                    if gone:
                        self.lost[f] = gone
                    else:
                        self.lost.pop(f, None)

    @staticmethod
    def _out_of_bounds(x: dict, n: float | None) -> tuple[str, str] | None:
        if n is None:
            return None
        if not math.isfinite(n) or (x.get("integer") and n != int(n)):
            return "invalid-variable-value", f"{x['id']} is {n}"
        if x.get("minimum") is not None and n < x["minimum"]:
            return "variable-underflow", f"{x['id']} is {n}, below {x['minimum']}"
        if x.get("maximum") is not None and n > x["maximum"]:
            return "variable-overflow", f"{x['id']} is {n}, above {x['maximum']}"
        return None

    def _exclusive(self, subject: str) -> Iterator[Finding]:
        for g in sorted(self.clashing):
            yield "exclusive-proposition-conflict", "error", subject, f"{g}: {', '.join(sorted(self.groups[g]))}"

    def _bounds(self, subject: str) -> Iterator[Finding]:
        for _, (code, detail) in sorted(self.broken.items()):
            yield code, "error", subject, detail

    def _carrier_loss(self, s: State, subject: str) -> Iterator[Finding]:
        for f, gone in sorted(self.lost.items()):
            if f not in s.resolved:
                all_gone = len(gone) == len(set(self.carriers[f]))
                yield "inactive-function-carrier", "error" if all_gone and self.functions[f].get("required") else "warning", subject, f"{f} loses {', '.join(gone)}"

    def _holds(self, s: State, c: dict) -> bool:
        n = s.variables.get(c["variableId"])
        return n is not None and COMPARE[c["operator"]](n, c["value"])

    def _before(self, s: State, e: dict) -> Iterator[Finding]:
        """What an event needs."""
        i, pre = e["id"], e.get("preconditions", {})
        for p in e.get("causalParentEventIds", []):
            if p not in self.active_ids:
                yield "missing-active-causal-parent", "error", i, p
            elif p not in s.done:
                yield "unresolved-causal-parent", "error", i, p
            if p in self.events:
                t = self.events[p]["time"]
                if t["earliest"] > e["time"]["latest"]:
                    yield "causal-time", "error", i, p
                elif t["latest"] > e["time"]["earliest"]:
                    yield "causal-time-ambiguous", "warning", i, p
        for x in [*e.get("participantIds", []), *pre.get("requiredActiveEntityIds", [])]:
            if x not in s.entities:
                yield "inactive-entity", "error", i, x
        for p in pre.get("requiredPropositionIds", []):
            if p not in s.propositions:
                yield "missing-required-proposition", "error", i, p
        for p in pre.get("forbiddenPropositionIds", []):
            if p in s.propositions:
                yield "forbidden-proposition-active", "error", i, p
        for k in pre.get("knowledge", []):
            if (k["actorId"], k["propositionId"]) not in s.knowledge:
                yield "missing-knowledge", "error", i, f"{k['actorId']} {k['propositionId']}"
        for k in pre.get("capabilities", []):
            if (k["entityId"], k["capabilityId"]) not in s.capabilities:
                yield "missing-capability", "error", i, f"{k['entityId']} {k['capabilityId']}"
        for c in pre.get("variables", []):
            if not self._holds(s, c):
                yield "variable-precondition", "error", i, f"{c['variableId']} {c['operator']} {c['value']}"
        eff = e.get("effects", {})
        for p in sorted(set(eff.get("establishPropositionIds", [])) & set(eff.get("negatePropositionIds", []))):
            yield "contradictory-event-effect", "error", i, p
        for x in e.get("participantIds", []):
            yield from self._travel(s, e, x)

    def _travel(self, s: State, e: dict, who: str) -> Iterator[Finding]:
        """Moves `who` to the event if there is time enough."""
        to, t = e.get("locationId"), e["time"]
        if not to:
            return
        here, was = (to, t["earliest"], t["latest"]), s.places.get(who)
        if was is None:
            yield "unbounded-origin", "notice", e["id"], who
        elif was[0] != to:
            need = travel_time(was[0], to, self.edges, {c for x, c in s.capabilities if x == who})
            if need is None:
                yield "missing-travel-path", "error", e["id"], f"{who}: {was[0]} to {to}"
                return
            if was[1] + need > t["latest"]:
                yield "impossible-travel", "error", e["id"], f"{who} needs {need} from {was[0]}"
                return
            if was[2] + need > t["earliest"]:
                yield "travel-window-ambiguous", "warning", e["id"], who
        s.put("places", who, here)

    def _apply(self, s: State, e: dict) -> None:
        """Effects in their fixed order."""
        get = lambda key: e.get("effects", {}).get(key, [])
        pairs = lambda key, a, b: [(k[a], k[b]) for k in get(key)]
        moves = {m["entityId"]: (m["toLocationId"], e["time"]["earliest"], e["time"]["latest"]) for m in get("moveEntities")}
        changes: list[tuple[str, bool, Iterable]] = [
            ("propositions", False, get("negatePropositionIds")), ("propositions", True, get("establishPropositionIds")), ("knowledge", True, pairs("grantKnowledge", "actorId", "propositionId")),
            ("capabilities", True, pairs("grantCapabilities", "entityId", "capabilityId")), ("capabilities", False, pairs("revokeCapabilities", "entityId", "capabilityId")),
        ]
        for kind, on, keys in changes:
            for key in keys:
                s.put(kind, key) if on else s.drop(kind, key)
        for c in get("variableSets"):
            s.put("variables", c["variableId"], c["value"])
        for c in get("variableDeltas"):
            if c["variableId"] in s.variables:
                s.put("variables", c["variableId"], s.variables[c["variableId"]] + c["delta"])
        for who, place in moves.items():
            s.put("places", who, place)
        for x in get("activateEntityIds"):
            s.put("entities", x)
        for x in get("deactivateEntityIds"):
            s.drop("entities", x)
        for f in get("resolveFunctionIds"):
            if f not in self.retired:
                s.put("resolved", f)

    def _endpoint(self, s: State, e: dict, p: dict) -> Iterator[Finding]:
        i, t, w = e["id"], e["time"], p["window"]
        if p["id"] in s.fulfilled:
            yield "duplicate-endpoint-fulfillment", "error", i, p["id"]
        if t["latest"] < w["earliest"] or t["earliest"] > w["latest"]:
            yield "endpoint-window", "error", i, p["id"]
        elif t["earliest"] < w["earliest"] or t["latest"] > w["latest"]:
            yield "endpoint-window-ambiguous", "warning", i, p["id"]
        for q in p.get("predecessorEndpointIds", []):
            if q not in s.fulfilled or s.fulfilled[q][1] >= e["sequence"]:
                yield "endpoint-order", "error", i, f"{p['id']} after {q}"
        for q in p.get("requiredPropositionIds", []):
            if q not in s.propositions:
                yield "endpoint-required-proposition", "error", i, f"{p['id']} {q}"
        for q in p.get("forbiddenPropositionIds", []):
            if q in s.propositions:
                yield "endpoint-forbidden-proposition", "error", i, f"{p['id']} {q}"
        for c in p.get("variableConstraints", []):
            if not self._holds(s, c):
                yield "endpoint-variable-constraint", "error", i, f"{p['id']} {c['variableId']}"
        for q in p.get("requiredResolvedFunctionIds", []):
            if q not in s.resolved:
                yield "endpoint-unresolved-function", "error", i, f"{p['id']} {q}"

    def step(self, e: dict) -> bool:
        """Apply an event, or put all back if it finds an error; its findings are kept either way."""
        s, bad = self.state, lambda found: any(f[1] == "error" for f in found)
        found = list(self._before(s, e))
        fine = not bad(found)
        if fine:
            self._apply(s, e)
            self._refresh(s, s.log)
            found += [*self._exclusive(e["id"]), *self._bounds(e["id"]), *self._carrier_loss(s, e["id"])]
            met = [self.endpoints[p] for p in e.get("fulfillsEndpointIds", []) if p in self.endpoints]
            for p in {p["id"]: p for p in met}.values():
                found += self._endpoint(s, e, p)
            fine = not bad(found)
        self.findings += found
        if fine:
            for p in met:
                s.put("fulfilled", p["id"], (e["id"], e["sequence"]))
            self._finish(e)
        else:
            touched = list(s.log)
            s.undo()
            self._refresh(s, touched)
        return fine

    def _finish(self, e: dict) -> None:
        self.state.put("done", e["id"])
        self.last = max(self.last, e["sequence"])
        self.state.log.clear()

    def fold(self, require_closure: bool = False) -> dict:
        """The receipt: findings in order, what was reached, whether all that must close did."""
        for e in self.active_events:
            self.step(e)
        return self.receipt(require_closure)

    def receipt(self, require_closure: bool = False) -> dict:
        bad = lambda found: any(f[1] == "error" for f in found)
        s, last = self.state, self.last
        grave = "error" if require_closure else "warning"
        for p, x in sorted(self.endpoints.items()):
            if x.get("hard") and p not in s.fulfilled:
                self.findings.append(("unmet-endpoint", grave, p, "no event fulfils it"))
        for f, x in sorted(self.functions.items()):
            if x.get("required") and f not in self.retired | s.resolved:
                late = x.get("deadlineSequence") is not None and last >= x["deadlineSequence"]
                self.findings.append(("function-deadline-missed", "error", f, f"after {x['deadlineSequence']}") if late else ("unresolved-function", grave, f, "not resolved"))
        closed = not bad(self.findings) and all(p in s.fulfilled for p, x in self.endpoints.items() if x.get("hard")) and all(f in s.resolved for f, x in self.functions.items() if x.get("required"))
        return {
            "passed": not bad(self.findings),
            "closure_complete": closed,
            "findings": sorted(self.findings, key=lambda f: (ORDER[f[1]], f[2], f[0], f[3])),
            "completed": sorted(s.done),
            "active_events": sorted(e["id"] for e in self.active_events),
            "entities": sorted(s.entities),
            "propositions": sorted(s.propositions),
            "variables": dict(sorted(s.variables.items())),
            "places": {k: v[0] for k, v in sorted(s.places.items())},
            "resolved": sorted(s.resolved),
            "fulfilled": {k: v[0] for k, v in sorted(s.fulfilled.items(), key=lambda x: (x[1][1], x[0]))},
        }


RECEIPT = (
    "branch_id string, passed boolean, closure_complete boolean, findings array<struct<code:string,severity:string,subject:string,detail:string>>, completed array<string>, "
    "entities array<string>, propositions array<string>, variables map<string,double>, places map<string,string>, resolved array<string>, fulfilled map<string,string>"
)


def compile_branches(branches: DataFrame, require_closure: bool = False) -> DataFrame:
    """Receipts of branches (branch_id, bible, decisions, extra_events), each a JSON text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                out = Branch(json.loads(r.bible), json.loads(r.decisions), json.loads(r.extra_events or "[]")).fold(require_closure)
                keys = ("code", "severity", "subject", "detail")
                rows.append([r.branch_id, out["passed"], out["closure_complete"], [dict(zip(keys, f, strict=True)) for f in out["findings"]], *(out[k] for k in ("completed", "entities", "propositions"))] + [{k: float(v) for k, v in out["variables"].items()}, out["places"], out["resolved"], out["fulfilled"]])
            yield pd.DataFrame(rows, columns=[p.split()[0] for p in ("branch_id passed closure_complete findings completed entities propositions variables places resolved fulfilled").split()])

    return branches.select("branch_id", "bible", "decisions", "extra_events").mapInPandas(run, RECEIPT)


def classify_proposals(bible: DataFrame, proposals: DataFrame) -> DataFrame:
    """(proposal_id, classification, codes) of proposals (proposal_id, event) for one bible (bible, decisions).

    Each proposal is a branch with its event enabled; what it closes that the bare branch leaves
    open is its coverage, and how many proposals cover a thing decides the class.
    """
    from tarnwick.operators.recall import classify

    # one row of bible: the join is with a single row
    one = F.concat(F.lit("["), F.col("event"), F.lit("]")).alias("extra_events")
    branches = proposals.join(F.broadcast(bible.limit(1))).select(F.col("proposal_id").alias("branch_id"), "bible", "decisions", one)
    bare = compile_branches(bible.limit(1).select(F.lit("").alias("branch_id"), "bible", "decisions", F.lit("[]").alias("extra_events")))
    open_now = bare.select(F.explode(F.filter("findings", lambda f: f["code"].isin("unmet-endpoint", "unresolved-function", "function-deadline-missed"))).alias("f")).select(F.col("f.subject").alias("key"))
    receipts = compile_branches(branches)
    events = proposals.select("proposal_id", F.get_json_object("event", "$.id").alias("event_id"), F.from_json(F.get_json_object("event", "$.effects.resolveFunctionIds"), "array<string>").alias("resolves"))
    r = receipts.join(events, F.col("branch_id") == F.col("proposal_id"))
    own = F.map_keys(F.map_filter("fulfilled", lambda k, v: v == F.col("event_id")))
    closes = F.array_union(own, F.array_intersect("resolved", F.coalesce("resolves", F.array().cast("array<string>"))))
    r = r.withColumn("closes", closes)
    coverage = r.select("proposal_id", F.explode("closes").alias("key")).join(F.broadcast(open_now), "key", "left_semi")
    wrong = F.array_sort(F.array_distinct(F.transform(F.filter("findings", lambda f: f["severity"] == "error"), lambda f: f["code"])))
    verdict = r.select("proposal_id", (~F.col("passed")).alias("contradicted"), wrong.alias("codes"))
    return classify(coverage, verdict.select("proposal_id", "contradicted")).join(verdict.select("proposal_id", "codes"), "proposal_id")
