"""Bible rules, forbidden content, admissions, URLs and HTTP outcomes on small fixtures."""

from pyspark.sql import functions as F

from tarnwick.functions import web
from tarnwick.operators import dossier, review, validate
from tests.test_operators import one


def test_bible(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    bible = {
        "continuities": t([("a", "A", ["b"]), ("b", "B", ["a"]), ("c", " ", [])], "id string, label string, inherits_from_ids array<string>"),
        "entities": t([("x", "X", ["a"], []), ("x", "Y", ["nope"], [])], "id string, label string, continuity_ids array<string>, locator_ids array<string>"),
        "state_variables": t([("v", "V", "x", ["a"], 5.5, 0.0, 10.0, True), ("w", "W", None, ["a"], 50.0, 0.0, 10.0, False)], "id string, label string, subject_id string, continuity_ids array<string>, initial_value double, minimum double, maximum double, integer boolean"),
        "events": t([("e1", 5, 1.0, 2.0, []), ("e2", 5, 3.0, 1.0, ["e1"])], "id string, sequence int, earliest double, latest double, causal_parent_event_ids array<string>"),
    }
    got = {(r.code, r.subject) for r in validate.bible_findings(bible).collect()}
    assert got == {
        ("continuity-cycle", "a"), ("continuity-cycle", "b"), ("missing-text", "c"), ("duplicate-id", "x"), ("missing-reference", "x"),
        ("invalid-variable-value", "v"), ("variable-bounds", "w"), ("invalid-time-window", "e2"), ("causal-order", "e2"),
    }


def _table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def _bible(spark):
    texts = "id string, label string, description string"
    return {
        "bible": _table(spark, "id string, format string, version string, title string, description string", ("B", "f/1", "1", "T", None)),
        "continuities": _table(spark, "id string, label string, inherits_from_ids array<string>", ("main", "M", []), ("side", "S", ["main"]), ("far", "F", ["ring"]), ("ring", "R", ["far"]), ("lead", "L", ["far"]), ("own", "O", ["own"])),
        "entities": _table(spark, "id string, label string, kind string", ("ann", "Ann", "actor"), ("town", "Town", "location")),
        "propositions": _table(spark, "id string, predicate string, object struct<entity_id: string>", ("p1", "is", ("ann",)), ("p2", "is", ("gone",)), ("p3", "is", None)),
        "narrative_functions": _table(spark, f"{texts}, required boolean, default_carrier_ids array<string>, deadline_sequence double", ("f1", "F", "d", True, [], 1.0), ("f2", "F", "d", False, [], 1.5)),
        "state_variables": _table(spark, f"{texts}, unit string, initial_value double, minimum double, maximum double, integer boolean", ("v", "V", "d", "u", 5.0, 0.0, 10.0, True), ("w", "W", "d", "u", 11.0, 0.0, 10.0, True), ("x", "X", "d", "u", 1.5, 9.0, None, True)),
        "events": _table(
            spark,
            "id string, label string, sequence int, earliest double, latest double, location_id string, causal_parent_event_ids array<string>, effects struct<variable_sets: array<struct<variable_id: string, value: double>>, "
            "variable_deltas: array<struct<variable_id: string, delta: double>>, move_entities: array<struct<entity_id: string, to_location_id: string>>>",
            ("e1", "E", 1, 1.0, 2.0, "town", [], ([("v", 3.0)], [], [("ann", "town")])),
            ("e2", "E", 2, 1.0, float("inf"), "ann", ["e1"], ([("v", 30.0), ("v", 1.0), ("none", 1.0)], [("v", float("nan")), ("no", 1.0)], [("ann", "ann")])),
        ),
        "endpoints": _table(spark, f"{texts}, earliest double, latest double, predecessor_endpoint_ids array<string>", ("n1", "N", "d", 1.0, 2.0, ["n1"]), ("n2", "N", "d", None, 2.0, ["n1"])),
        "variant_groups": _table(
            spark, f"{texts}, cardinality string, continuity_ids array<string>, option_ids array<string>", ("g1", "G", "d", "exactly-one", ["main"], ["o1", "o2", "o2"]), ("g2", "G", "d", "any", ["main"], []), ("g3", "G", "d", "zero-or-one", ["side"], []), ("g4", "G", "d", "one-or-more", ["far"], ["o4", "o1"])
        ),
        "variant_options": _table(
            spark,
            f"{texts}, group_id string, requires_option_ids array<string>, conflicts_with_option_ids array<string>, effects struct<variable_overrides: array<struct<variable_id: string, value: double>>, function_assignments: array<struct<function_id: string, carrier_ids: array<string>, assigned_by: string>>>",
            ("o1", "O", "d", "g1", ["o4"], ["o2"], ([("v", 1.0), ("v", 2.0)], [("f1", ["ann", "who"], "me")])), ("o2", "O", "d", "g1", [], [], ([], [("f1", [], " ")])), ("o3", "O", "d", "g1", [], [], None), ("o4", "O", "d", "g4", [], [], None),
        ),
        "initial_state": _table(spark, "id string, active_proposition_ids array<string>, entity_locations array<struct<entity_id: string, location_id: string, earliest: double, latest: double>>", ("initialState", ["p9"], [("ann", "town", 3.0, 1.0)])),
    }


def test_every_bible_rule(spark):
    bible = _bible(spark)
    got = sorted((r.code, r.subject, r.detail) for r in validate.bible_findings(bible, "f/1").collect())
    lost = [("p2", "gone"), ("e2", "ann"), ("e2", "ann"), ("e2", "none"), ("e2", "no"), ("o1", "who"), ("initialState", "p9")]
    assert got == sorted(
        [("missing-reference", a, b) for a, b in lost]
        + [("continuity-cycle", n, "") for n in ("far", "ring", "lead", "own")]
        + [("continuity-cycle", "own", "itself"), ("endpoint-cycle", "n1", ""), ("missing-text", "B", "bible.description"), ("missing-text", "o2", "variant_options.effects.function_assignments.assigned_by")]
        + [("missing-default-carrier", "f1", ""), ("invalid-sequence", "f2", "")]
        + [("variable-bounds", "w", ""), ("invalid-variable-value", "x", ""), ("variable-bounds", "e2", "v"), ("invalid-variable-value", "e2", "v")]
        + [("duplicate-variable-effect", "e2", "v"), ("contradictory-variable-effect", "e2", "v"), ("invalid-time-window", "e2", ""), ("invalid-time-window", "initialState:ann", "")]
        + [("duplicate-id", "g1", "o2"), ("variant-membership", "g4", "o1"), ("variant-membership", "o3", "g1"), ("empty-variant-group", "g3", "")]
        + [("duplicate-variable-override", "o1", "v"), ("empty-function-assignment", "o2", "f1")]
    )
    assert [r.code for r in validate.bible_findings(bible, "f/2").collect()] == ["invalid-format"]
    empty = {name: t.limit(0) for name, t in bible.items()}
    assert validate.bible_findings(empty, "f/1").count() == 0


SETS = (
    "id string, format string, bible_id string, bible_version string, target_continuity_id string, selected_option_ids array<string>, assume_proposition_ids array<string>, exclude_proposition_ids array<string>, variable_overrides array<struct<variable_id: string, value: double>>, "
    "function_assignments array<struct<function_id: string, carrier_ids: array<string>, assigned_by: string, locator_ids: array<string>>>, function_retirements array<struct<function_id: string, rationale: string, locator_ids: array<string>>>"
)


def test_every_decision_rule(spark):
    who = lambda f: (f, ["ann"], "me", [])
    sets = _table(
        spark,
        SETS,
        ("fine", "d/1", "B", "1", "side", ["o2"], ["p1"], ["p2"], [("v", 1.0)], [who("f1")], [("f2", "why", [])]),
        ("other", "d/2", "X", "9", "nowhere", [], [], [], [], [], []),
        ("lost", "d/1", "X", "9", "nowhere", ["zz"], [], [], [], [], []),
        ("bad", "d/1", "B", "1", "main", ["o1", "o2", "o4", "zz", "zz"], ["p1"], ["p1"], [("v", 99.0), ("v", 1.5)], [who("f1"), who("f1"), ("f2", [], "", [])], [("f1", " ", []), ("f9", "why", []), ("f9", "why", [])]),
        ("none", "d/1", "B", "1", "far", None, None, None, None, None, None),
    )
    got = sorted((r.code, r.subject, r.detail) for r in validate.decision_set_findings(_bible(spark), sets, "B", "1", "d/1").collect())
    assert got == sorted(
        [("invalid-format", "other", ""), ("bible-mismatch", "lost", "X"), ("bible-version-mismatch", "lost", "9"), ("missing-reference", "lost", "nowhere")]
        + [("missing-reference", "bad", x) for x in ("zz", "zz", "f9", "f9")]
        + [("duplicate-id", "bad", "zz"), ("contradictory-decision", "bad", "p1"), ("contradictory-decision", "bad", "f1"), ("variable-bounds", "bad", "v"), ("invalid-variable-value", "bad", "v"), ("duplicate-variable-override", "bad", "v")]
        + [("conflicting-function-assignment", "bad", "f1"), ("duplicate-retirement", "bad", "f9"), ("empty-function-assignment", "bad", "f2")]
        + [("missing-text", "bad", "decision_sets.function_assignments.assigned_by"), ("missing-text", "bad", "decision_sets.function_retirements.rationale")]
        + [("variant-cardinality", "g1", "bad: exactly-one selected 3 of 3"), ("variant-cardinality", "g1", "fine: exactly-one selected 2 of 3"), ("conflicting-option", "o1", "bad: o2"), ("foreign-continuity-option", "o4", "bad")]
        + [("variant-cardinality", "g4", "none: one-or-more selected 0 of 2")]
    )


def test_forbidden_content(spark):
    rows = [("ok", '{"a":1,"text":null}'), ("key", '{"a":{"text":"x"}}'), ("path", '{"a":"/home/me/x"}'), ("bad", "{")]
    got = {(r.code, r.subject) for r in validate.forbidden_content(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert got == {("forbidden-key", "key"), ("forbidden-path", "path"), ("invalid-json", "bad")}


def test_admissions(spark):
    matrix = {"admit": ("supports", ("on-topic",)), "reject": ("contradicts", ("off-topic",))}
    schema = "admission_id string, outcome string, reason string, rationale string, reviewed_by string, reviewed_at string, lanes array<string>, digests array<string>, evidence array<struct<effect:string,value:string,note:string>>"
    good = ("g", "admit", "on-topic", "a reason that is long enough to be one", "Ann", "2024-01-01T00:00:00Z", ["l"], ["sha256:" + "0" * 64], [("supports", "v", "n")])
    bad = ("b", "admit", "off-topic", "short", " ", "never", ["l", "l"], ["x"], [("contradicts", "", "n"), ("contradicts", "", "n")])
    got = dossier.admission_findings(spark.createDataFrame([good, bad], schema), matrix).collect()
    assert {r.subject for r in got} == {"b"} and len({r.code for r in got}) == 8


def test_web(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    wait = lambda v: one(spark, v, lambda c: web.retry_after_ms(c, now))
    assert [wait(v) for v in ("2", "0.5", "9999", "-1", "x", None, "Mon, 01 Jan 2024 00:00:03 GMT", "Sun, 31 Dec 2023 00:00:00 GMT")] == [2000, 500, 300_000, None, None, None, 3000, 0]
    ok = lambda u: one(spark, u, lambda c: web.endpoint_allowed(c, "h.org", "^/api"))
    assert [ok(u) for u in ("https://h.org/api?q", "http://h.org/api", "https://x.org/api", "https://u:p@h.org/api", "https://h.org/api#x", "nope", None)] == [True, *[False] * 6]


def test_review_names(spark):
    assert [one(spark, n, review.named_reviewer) for n in ("  Ann   Lee ", "ab", "Anonymous", None)] == ["Ann Lee", None, None, None]
