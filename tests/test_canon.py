"""The fold on a small synthetic bible: classes of proposals, rollback, travel, closure."""

import copy
import json
import random
import time

from tarnwick.operators.canon import Branch, classify_proposals, compile_branches, travel_time
from tarnwick.streaming import branches

WHEN = lambda a, b: {"earliest": a, "latest": b}
C = ["main"]


def event(i, seq, t=(8, 12), **more):
    return {"id": i, "sequence": seq, "time": WHEN(*t), "continuityIds": C, "enabledByDefault": True, "participantIds": [], **more}


def bible():
    return {
        "continuities": [{"id": "main", "inheritsFromIds": ["base"]}, {"id": "base", "inheritsFromIds": []}],
        "entities": [{"id": e, "continuityIds": C} for e in ("ann", "bob")],
        "propositions": [
            {"id": "p1", "continuityIds": C, "enabledByDefault": True, "exclusiveGroupId": "g"},
            {"id": "p2", "continuityIds": C, "enabledByDefault": False, "exclusiveGroupId": "g"},
            {"id": "p3", "continuityIds": ["base"], "enabledByDefault": False},
        ],
        "capabilities": [{"id": "ship", "continuityIds": C}],
        "stateVariables": [{"id": "gold", "initialValue": 100, "minimum": 0, "maximum": 1000, "integer": True, "continuityIds": C}],
        "travelEdges": [
            {"fromLocationId": "x", "toLocationId": "y", "minimumDuration": 4, "requiredCapabilityIds": [], "continuityIds": C},
            {"fromLocationId": "x", "toLocationId": "y", "minimumDuration": 1, "requiredCapabilityIds": ["ship"], "continuityIds": C},
        ],
        "narrativeFunctions": [{"id": f, "required": True, "defaultCarrierIds": ["ann"], "continuityIds": C} for f in ("f1", "f2")],
        "endpoints": [{"id": "end", "hard": True, "window": WHEN(8, 12), "continuityIds": C, "variableConstraints": [{"variableId": "gold", "operator": "gte", "value": 20}]}],
        "events": [event("e1", 1, (1, 2), effects={"variableDeltas": [{"variableId": "gold", "delta": -10}]})],
        "variantOptions": [],
        "initialState": {"activePropositionIds": [], "knowledge": [], "capabilities": [], "functionAssignments": [], "entityLocations": [{"entityId": "ann", "locationId": "x", "time": WHEN(0, 0)}]},
    }


DECISIONS = {"id": "d", "targetContinuityId": "main", "selectedOptionIds": []}


def test_rollback_leaves_the_variable():
    b = bible()
    b["events"].append(event("e2", 2, effects={"variableDeltas": [{"variableId": "gold", "delta": -500}]}))
    out = Branch(b, DECISIONS).fold()
    assert out["variables"] == {"gold": 90} and out["completed"] == ["e1"] and not out["passed"]
    assert "variable-underflow" in {f[0] for f in out["findings"]}


def test_exclusive_propositions_and_scope():
    b = bible()
    b["events"].append(event("e2", 2, effects={"establishPropositionIds": ["p2"]}))
    out = Branch(b, DECISIONS).fold()
    assert "exclusive-proposition-conflict" in {f[0] for f in out["findings"]} and out["propositions"] == ["p1"]
    b["events"][-1]["effects"]["negatePropositionIds"] = ["p1"]
    assert Branch(b, DECISIONS).fold()["propositions"] == ["p2"]


def test_travel():
    b = bible()
    assert travel_time("x", "y", b["travelEdges"], set()) == 4 and travel_time("x", "y", b["travelEdges"], {"ship"}) == 1
    assert travel_time("y", "x", b["travelEdges"], set()) is None and travel_time("x", "x", [], set()) == 0
    b["events"].append(event("e2", 2, (2, 3), participantIds=["ann"], locationId="y"))
    assert "impossible-travel" in {f[0] for f in Branch(b, DECISIONS).fold()["findings"]}
    b["initialState"]["capabilities"] = [{"entityId": "ann", "capabilityId": "ship"}]
    assert Branch(b, DECISIONS).fold()["places"] == {"ann": "y"}


def test_overrides_deadlines_and_conflicts():
    b = bible()
    opt = lambda i, v: {"id": i, "effects": {"variableOverrides": [{"variableId": "gold", "value": v}]}}
    b["variantOptions"] = [opt("o1", 5), opt("o2", 6)]
    one = Branch(b, {**DECISIONS, "selectedOptionIds": ["o1"], "variableOverrides": [{"variableId": "gold", "value": 50}]}).fold()
    assert one["variables"]["gold"] == 40
    both = Branch(b, {**DECISIONS, "selectedOptionIds": ["o1", "o2"]}).fold()
    assert "conflicting-variable-override" in {f[0] for f in both["findings"]}
    b["narrativeFunctions"][0]["deadlineSequence"] = 1
    assert ("function-deadline-missed", "f1") in {(f[0], f[2]) for f in Branch(b, DECISIONS).fold()["findings"]}


def test_classes_of_proposals(spark):
    resolve = lambda *f: {"resolveFunctionIds": list(f)}
    proposals = [
        ("a-necessary", event("n1", 5, fulfillsEndpointIds=["end"])),
        ("b-implied", event("n2", 5, effects=resolve("f1"))),
        ("c-implied", event("n3", 5, effects=resolve("f1"))),
        ("d-permissible", event("n4", 5)),
        ("e-contradicted", event("n5", 5, effects={"variableDeltas": [{"variableId": "gold", "delta": -1000}]})),
    ]
    for _, e in proposals:
        e["enabledByDefault"] = False
    one = spark.createDataFrame([(json.dumps(bible()), json.dumps(DECISIONS))], "bible string, decisions string")
    rows = spark.createDataFrame([(i, json.dumps(e)) for i, e in proposals], "proposal_id string, event string")
    got = {r.proposal_id: r.classification for r in classify_proposals(one, rows).collect()}
    assert got == {"a-necessary": "necessary", "b-implied": "strongly-implied", "c-implied": "strongly-implied", "d-permissible": "permissible", "e-contradicted": "contradicted"}


def test_branches_fold_apart(spark):
    rows = [(str(i), json.dumps(bible()), json.dumps(DECISIONS), None) for i in range(5)]
    out = compile_branches(spark.createDataFrame(rows, "branch_id string, bible string, decisions string, extra_events string"), require_closure=True).collect()
    assert len(out) == 5 and all(not r.passed and "unmet-endpoint" in {f.code for f in r.findings} for r in out)


def many_events(n, seed):
    """Events that establish, negate, move, spend and remove, about half of them against some rule."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        effects = {
            "establishPropositionIds": r.choices(["p1", "p2", "p3"], k=r.randrange(2)), "negatePropositionIds": r.choices(["p1", "p2"], k=r.randrange(2)),
            "variableDeltas": [{"variableId": "gold", "delta": r.randrange(-60, 60)}] * r.randrange(2), "activateEntityIds": ["ann", "bob"] if r.random() < 0.3 else [], "deactivateEntityIds": ["bob"] if r.random() < 0.2 else [],
            "grantCapabilities": [{"entityId": "ann", "capabilityId": "ship"}] * r.randrange(2), "revokeCapabilities": [{"entityId": "ann", "capabilityId": "ship"}] if r.random() < 0.2 else [],
            "grantKnowledge": [{"actorId": "ann", "propositionId": "p3"}] * r.randrange(2), "resolveFunctionIds": ["f1"] if r.random() < 0.1 else [],
        }
        more = {"participantIds": r.choices(["ann", "bob"], k=r.randrange(2)), "causalParentEventIds": [f"x{r.randrange(i):06d}"] if i and r.random() < 0.3 else []}
        more["preconditions"] = {"requiredPropositionIds": ["p3"] if r.random() < 0.1 else [], "knowledge": [{"actorId": "ann", "propositionId": "p3"}] if r.random() < 0.1 else []}
        place = {"locationId": r.choice("xy")} if r.random() < 0.5 else {}
        out.append(event(f"x{i:06d}", i + 1, (i * 3, i * 3 + 2), effects=effects, fulfillsEndpointIds=["end"] if r.random() < 0.1 else [], **more, **place))
    return out


def test_undo_equals_a_copy():
    for seed in range(6):
        b = bible() | {"events": many_events(60, seed)}
        fast, slow = Branch(b, DECISIONS), Branch(b, DECISIONS)
        for e in slow.active_events:
            kept = copy.deepcopy(slow)
            if not slow.step(e):
                kept.findings = slow.findings
                slow = kept
        whole = fast.fold()
        assert whole == slow.receipt()
        assert 5 < len(whole["completed"]) < 55
        # what is kept up by touch is what a look at the whole state gives
        s = fast.state
        groups = {p: x.get("exclusiveGroupId") for p, x in fast.propositions.items()}
        assert fast.clashing == {g for g in groups.values() if g and sum(groups.get(p) == g for p in s.propositions) > 1}
        assert fast.lost == {f: gone for f, own in fast.carriers.items() if (gone := sorted(set(own) - s.entities))}


def test_a_long_branch_takes_linear_time():
    def seconds(n):
        wide = bible() | {"events": many_events(n, 1)}
        wide["stateVariables"] = wide["stateVariables"] + [{"id": f"v{i}", "initialValue": 0, "continuityIds": C} for i in range(n // 10)]
        branch = Branch(wide, DECISIONS)
        at = time.process_time()
        assert len(branch.fold()["active_events"]) == n
        return time.process_time() - at

    seconds(500)
    few, many = seconds(2_500), seconds(20_000)
    assert many < 8 * few * 3


def as_rows(seeds, n):
    world = json.dumps({"bible": {k: v for k, v in bible().items() if k != "events"}, "decisions": DECISIONS})
    events = {f"b{s}": many_events(n, s) for s in seeds}
    return [(b, "world", world) for b in events], [(b, e["sequence"], "event", json.dumps(e)) for b, es in events.items() for e in es]


def test_keyed_state_on_a_table_and_on_a_stream(spark, tmp_path):
    worlds, events = as_rows(range(3), 45)
    schema = "branch_id string, kind string, body string"
    rows = worlds + [(b, k, body) for b, _, k, body in events]
    odd = [("b0", "event", None), ("b0", "event", "{"), ("b0", "event", "[]"), ("b0", *rows[3][1:]), ("none", "event", rows[3][2])]
    table = spark.createDataFrame(rows + odd, schema).repartition(3)
    expected = {f"b{s}": Branch(bible() | {"events": many_events(45, s)}, DECISIONS).fold() for s in range(3)}

    def check(got, findings):
        assert set(got) == set(expected)
        for b, r in got.items():
            e = expected[b]
            assert r.completed == len(e["completed"]) and r.rolled_back == 45 - r.completed
            assert (r.propositions, r.variables, r.places, r.fulfilled) == (e["propositions"], e["variables"], e["places"], e["fulfilled"])
            end = ("unmet-endpoint", "unresolved-function", "function-deadline-missed")
            assert sorted(findings[b]) == sorted(tuple(f) for f in e["findings"] if f[0] not in end)

    out = branches.fold_rows(table).collect()
    check({r.branch_id: r for r in out}, {r.branch_id: [tuple(f) for f in r.findings] for r in out})
    # three micro-batches: events of the first come before their world
    source = tmp_path / "rows"
    for k, part in enumerate([[r[:1] + r[2:] for r in events if r[1] <= 15], worlds + [r[:1] + r[2:] for r in events if 15 < r[1] <= 30], [r[:1] + r[2:] for r in events if r[1] > 30]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(source))
        time.sleep(1.1 if k < 2 else 0)
    stream = branches.fold_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    got, findings = {}, {}

    def keep(batch, _):
        for r in batch.collect():
            got[r.branch_id] = r
            findings.setdefault(r.branch_id, []).extend(tuple(f) for f in r.findings)

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    check(got, findings)
