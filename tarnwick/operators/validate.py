"""Validation of a bible held as tables: one declarative list of rules, each a findings query.

A bible is a dict of DataFrames by table name, with columns in snake case. Tables that are absent
are not checked. Every rule is an aggregate, an anti-join or a filter, so tables of any size go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.utils import AnalysisException

from tarnwick.operators import graph
from tarnwick.operators.rules import duplicates, finding, missing_reference, union

Bible = dict[str, DataFrame]

#: Table: columns and the table that they refer to; a dotted column is a field of a struct, or of each struct of an array (fixed values).
REFERENCES: dict[str, tuple[tuple[str, str], ...]] = {
    "continuities": (("inherits_from_ids", "continuities"),),
    "sources": (("continuity_id", "continuities"), ("parent_source_ids", "sources")),
    "locators": (("source_id", "sources"),),
    "entities": (("continuity_ids", "continuities"), ("locator_ids", "locators")),
    "propositions": (("subject_id", "entities"), ("object.entity_id", "entities"), ("continuity_ids", "continuities"), ("locator_ids", "locators")),
    "attestations": (("proposition_id", "propositions"), ("locator_ids", "locators"), ("narrator_entity_id", "entities")),
    "capabilities": (("continuity_ids", "continuities"), ("locator_ids", "locators")),
    "state_variables": (("subject_id", "entities"), ("continuity_ids", "continuities"), ("locator_ids", "locators")),
    "travel_edges": (("from_location_id", "locations"), ("to_location_id", "locations"), ("required_capability_ids", "capabilities"), ("continuity_ids", "continuities"), ("locator_ids", "locators")),
    "narrative_functions": (("continuity_ids", "continuities"), ("default_carrier_ids", "entities"), ("required_by_endpoint_ids", "endpoints"), ("locator_ids", "locators")),
    "events": (
        ("continuity_ids", "continuities"), ("location_id", "locations"), ("participant_ids", "entities"), ("causal_parent_event_ids", "events"), ("fulfills_endpoint_ids", "endpoints"), ("locator_ids", "locators"),
        ("preconditions.required_proposition_ids", "propositions"), ("preconditions.forbidden_proposition_ids", "propositions"), ("preconditions.required_active_entity_ids", "entities"),
        ("preconditions.knowledge.actor_id", "entities"), ("preconditions.knowledge.proposition_id", "propositions"), ("preconditions.capabilities.entity_id", "entities"), ("preconditions.capabilities.capability_id", "capabilities"),
        ("effects.establish_proposition_ids", "propositions"), ("effects.negate_proposition_ids", "propositions"), ("effects.grant_knowledge.actor_id", "entities"), ("effects.grant_knowledge.proposition_id", "propositions"),
        ("effects.grant_capabilities.entity_id", "entities"), ("effects.grant_capabilities.capability_id", "capabilities"), ("effects.revoke_capabilities.entity_id", "entities"), ("effects.revoke_capabilities.capability_id", "capabilities"),
        ("effects.move_entities.entity_id", "entities"), ("effects.move_entities.to_location_id", "locations"), ("effects.activate_entity_ids", "entities"), ("effects.deactivate_entity_ids", "entities"),
        ("effects.resolve_function_ids", "narrative_functions"),
    ),
    "endpoints": (
        ("continuity_ids", "continuities"), ("predecessor_endpoint_ids", "endpoints"), ("required_proposition_ids", "propositions"), ("forbidden_proposition_ids", "propositions"),
        ("required_resolved_function_ids", "narrative_functions"), ("locator_ids", "locators"),
    ),
    "variant_groups": (("continuity_ids", "continuities"), ("option_ids", "variant_options"), ("locator_ids", "locators")),
    "variant_options": (
        ("group_id", "variant_groups"), ("requires_option_ids", "variant_options"), ("conflicts_with_option_ids", "variant_options"), ("effects.activate_proposition_ids", "propositions"),
        ("effects.deactivate_proposition_ids", "propositions"), ("effects.activate_event_ids", "events"), ("effects.deactivate_event_ids", "events"), ("effects.remove_entity_ids", "entities"),
        ("effects.function_assignments.function_id", "narrative_functions"), ("effects.function_assignments.carrier_ids", "entities"), ("effects.function_assignments.locator_ids", "locators"),
        ("effects.retire_function_ids", "narrative_functions"), ("locator_ids", "locators"),
    ),
    "initial_state": (
        ("active_proposition_ids", "propositions"), ("active_entity_ids", "entities"), ("entity_locations.entity_id", "entities"), ("entity_locations.location_id", "locations"), ("knowledge.actor_id", "entities"),
        ("knowledge.proposition_id", "propositions"), ("capabilities.entity_id", "entities"), ("capabilities.capability_id", "capabilities"), ("function_assignments.function_id", "narrative_functions"),
        ("function_assignments.carrier_ids", "entities"), ("function_assignments.locator_ids", "locators"),
    ),
    "decision_sets": (
        ("selected_option_ids", "variant_options"), ("assume_proposition_ids", "propositions"), ("exclude_proposition_ids", "propositions"), ("function_assignments.function_id", "narrative_functions"),
        ("function_assignments.carrier_ids", "entities"), ("function_assignments.locator_ids", "locators"), ("function_retirements.function_id", "narrative_functions"), ("function_retirements.locator_ids", "locators"),
    ),
}
#: Columns that must not be blank (fixed values).
TEXTS = {
    "bible": ("id", "version", "title", "description"), "continuities": ("id", "label"), "sources": ("id", "title", "version"), "locators": ("id", "unit"), "entities": ("id", "label"),
    "propositions": ("id", "predicate"), "capabilities": ("label", "description"), "state_variables": ("id", "label", "description", "unit"), "narrative_functions": ("label", "description"),
    "events": ("id", "label"), "endpoints": ("label", "description"), "variant_groups": ("label", "description"), "variant_options": ("label", "description", "effects.function_assignments.assigned_by"),
    "initial_state": ("function_assignments.assigned_by",), "decision_sets": ("function_assignments.assigned_by", "function_retirements.rationale"),
}
#: Columns whose values must differ within a row, and the code if they don't (fixed values).
UNIQUE = {
    "events": (("effects.variable_sets.variable_id", "duplicate-variable-effect"), ("effects.variable_deltas.variable_id", "duplicate-variable-effect")),
    "variant_groups": (("option_ids", "duplicate-id"),),
    "variant_options": (("effects.variable_overrides.variable_id", "duplicate-variable-override"),),
    "decision_sets": (
        ("selected_option_ids", "duplicate-id"), ("assume_proposition_ids", "duplicate-id"), ("exclude_proposition_ids", "duplicate-id"), ("variable_overrides.variable_id", "duplicate-variable-override"),
        ("function_assignments.function_id", "conflicting-function-assignment"), ("function_retirements.function_id", "duplicate-retirement"),
    ),
}
#: Arrays of which no value may stand in both, and the code if one does (fixed values).
APART = {
    "events": (("effects.variable_sets.variable_id", "effects.variable_deltas.variable_id", "contradictory-variable-effect"),),
    "decision_sets": (("assume_proposition_ids", "exclude_proposition_ids", "contradictory-decision"), ("function_retirements.function_id", "function_assignments.function_id", "contradictory-decision")),
}
#: Arrays of structs that name a variable, the number they give it, and whether that must lie within the variable's bounds (fixed values).
VARIABLES = {
    "events": (("effects.variable_sets", "value", True), ("preconditions.variables", "value", False), ("effects.variable_deltas", "delta", False)),
    "endpoints": (("variable_constraints", "value", False),),
    "variant_options": (("effects.variable_overrides", "value", True),),
    "decision_sets": (("variable_overrides", "value", True),),
}
#: Arrays of structs with carriers, of which there must be one (fixed values).
ASSIGNMENTS = {"variant_options": "effects.function_assignments", "initial_state": "function_assignments", "decision_sets": "function_assignments"}


def _levels(schema: StructType, path: str) -> int | None:
    """How many arrays a dotted path goes through, None if there is no such column."""
    at, n = schema, 0
    for name in path.split("."):
        while isinstance(at, ArrayType):
            at, n = at.elementType, n + 1
        if not isinstance(at, StructType) or name not in at.names:
            return None
        at = at[name].dataType
    while isinstance(at, ArrayType):
        at, n = at.elementType, n + 1
    return n


def _has(tables: Bible, name: str, path: str) -> bool:
    return name in tables and _levels(tables[name].schema, path) is not None


def _values(df: DataFrame, path: str) -> Column:
    """All values at a path of a row as one array<string>, empty where there are none."""
    n, c = _levels(df.schema, path), F.col(path)
    for _ in range(n - 1):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return F.coalesce((F.array(c) if n == 0 else c).cast("array<string>"), F.array().cast("array<string>"))


def _named(path: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(path).alias("path"), v.alias("value")))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _out_of_range(value: Column, whole: Column, low: Column, high: Column) -> Column:
    """The code of a variable's value, null where it may be so."""
    value = value.cast("double")
    wrong = ~_finite(value) | (F.coalesce(whole, F.lit(False)) & (value != F.floor(value)))
    return F.when(wrong, "invalid-variable-value").when((value < low) | (value > high), "variable-bounds")


def _lost(tables: Bible, known: Bible) -> list[DataFrame]:
    """Values of REFERENCES that their table lacks: one anti-join for each table referred to, whatever refers to it."""
    if "entities" in known:
        e = known["entities"]
        known = {**known, "locations": e.where("kind = 'location'") if "kind" in e.columns else e}
    out = []
    for other, target in known.items():
        parts = []
        for name, pairs in REFERENCES.items():
            paths = [p for p, t in pairs if t == other and _has(tables, name, p)]
            if paths:
                parts.append(tables[name].select(F.col("id").cast("string").alias("id"), F.explode(F.concat(*(_values(tables[name], p) for p in paths))).alias("ref")))
        if parts:
            refs = union(parts).where("ref IS NOT NULL")
            out.append(finding(refs.join(target.select(F.col("id").cast("string").alias("ref")).distinct(), "ref", "left_anti"), "missing-reference", "error", F.col("id"), F.col("ref")))
    return out


def _within(tables: Bible) -> list[DataFrame]:
    """Findings that need no other row: blank texts, values that repeat or stand in two places, assignments of nobody."""
    out = []
    for name, df in tables.items():
        own = F.coalesce(F.nullif(F.trim("id"), F.lit("")), F.lit(name)) if "id" in df.columns else F.lit(name)
        paths = [p for p in TEXTS.get(name, ()) if _has(tables, name, p)]
        if paths:
            cells = [_named(f"{name}.{p}", _values(df, p)) for p in paths]
            texts = df.select(own.alias("id"), F.explode(F.concat(*cells)).alias("t"))
            out.append(finding(texts.where(F.trim(F.coalesce("t.value", F.lit(""))) == ""), "missing-text", "error", F.col("id"), F.col("t.path")))
        for path, code in UNIQUE.get(name, ()):
            if _has(tables, name, path):
                each = df.select(F.monotonically_increasing_id().alias("row"), own.alias("id"), _values(df, path).alias("values")).select("row", "id", F.explode("values").alias("value"))
                out.append(finding(each.groupBy("row", "id", "value").count().where("count > 1"), code, "error", F.col("id"), F.col("value")))
        for path, other, code in APART.get(name, ()):
            if _has(tables, name, path) and _has(tables, name, other):
                both = df.select(own.alias("id"), F.explode(F.array_intersect(_values(df, path), _values(df, other))).alias("value"))
                out.append(finding(both, code, "error", F.col("id"), F.col("value")))
        path = ASSIGNMENTS.get(name)
        if path and _has(tables, name, path):
            each = df.select(own.alias("id"), F.explode(path).alias("a"))
            out.append(finding(each.where(F.coalesce(F.size("a.carrier_ids"), F.lit(0)) < 1), "empty-function-assignment", "error", F.col("id"), F.col("a.function_id")))
    return out


def _variables(tables: Bible, variables: DataFrame) -> list[DataFrame]:
    """What rows do with variables: that they exist and that numbers are finite, and within bounds where they are set."""
    parts = []
    for name, specs in VARIABLES.items():
        for path, number, bounded in specs:
            if _has(tables, name, path):
                each = tables[name].select(F.col("id").cast("string").alias("subject"), F.explode(path).alias("v"))
                parts.append(each.select("subject", F.col("v.variable_id").cast("string").alias("variable"), F.col(f"v.{number}").cast("double").alias("number"), F.lit(bounded).alias("bounded"), F.lit(number == "delta").alias("delta")))
    if not parts:
        return []
    known = variables.groupBy(F.col("id").cast("string").alias("variable")).agg(F.max(F.struct(F.col("integer").alias("whole"), F.col("minimum").cast("double").alias("low"), F.col("maximum").cast("double").alias("high"))).alias("k"))
    met = union(parts).join(known, "variable", "left")
    set_to = F.when(F.col("bounded"), _out_of_range(F.col("number"), F.col("k.whole"), F.col("k.low"), F.col("k.high"))).when(~_finite(F.col("number")), "invalid-variable-value")
    codes = F.array_compact(F.array(F.when(F.col("k").isNull(), "missing-reference"), F.when(F.col("k").isNotNull() | F.col("delta"), set_to)))
    return [met.select(F.explode(codes).alias("code"), F.lit("error").alias("severity"), "subject", F.col("variable").alias("detail"))]


def _checks() -> list[tuple[str, str, str, Column]]:
    """(table, code, severity, what is wrong)."""
    c, open_or = F.col, lambda x: F.col(x).isNull() | _finite(F.col(x))
    whole = lambda x: c(x) != F.floor(c(x))
    window = ~open_or("earliest") | ~open_or("latest") | (c("earliest") > c("latest"))
    initial = _out_of_range(c("initial_value"), c("integer"), c("minimum"), c("maximum"))
    return [
        ("locators", "invalid-locator-range", "error", ~open_or("start") | (c("start") < 0) | ~open_or("end") | (c("end") < 0) | (c("start") > c("end"))),
        ("attestations", "invalid-confidence", "error", (c("confidence_permille") < 0) | (c("confidence_permille") > 1000) | whole("confidence_permille")),
        ("state_variables", "invalid-variable-bounds", "error", ~open_or("minimum") | ~open_or("maximum") | (c("minimum") > c("maximum"))),
        ("state_variables", "invalid-variable-value", "error", initial == "invalid-variable-value"),
        ("state_variables", "variable-bounds", "error", initial == "variable-bounds"),
        ("travel_edges", "invalid-travel-duration", "error", ~open_or("minimum_duration") | (c("minimum_duration") < 0)),
        ("narrative_functions", "missing-default-carrier", "warning", c("required") & (F.size("default_carrier_ids") == 0)),
        ("narrative_functions", "invalid-sequence", "error", (c("deadline_sequence") < 0) | whole("deadline_sequence")),
        ("events", "invalid-sequence", "error", (c("sequence") < 0) | whole("sequence")),
        ("events", "invalid-time-window", "error", window),
        ("endpoints", "invalid-time-window", "error", window),
        ("endpoints", "endpoint-cycle", "error", F.array_contains("predecessor_endpoint_ids", c("id"))),
        ("continuities", "continuity-cycle", "error", F.array_contains("inherits_from_ids", c("id"))),
        ("variant_groups", "empty-variant-group", "error", (c("cardinality") != "any") & (F.coalesce(F.size("option_ids"), F.lit(0)) < 1)),
    ]


def _into_cycles(continuities: DataFrame) -> DataFrame:
    """(node): continuities that inherit, over any number of steps, from one that lies on a cycle; these themselves as well."""
    edges = continuities.select(F.col("id").cast("string").alias("src"), F.explode(F.col("inherits_from_ids").cast("array<string>")).alias("dst"))
    known = edges.join(continuities.select(F.col("id").cast("string").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    start = F.lit("\0")  # stands before all nodes on cycles, so that what leads there is found from one start
    back = known.select(F.col("dst").alias("src"), F.col("src").alias("dst")).unionByName(graph.cycle_nodes(known).select(start.alias("src"), F.col("node").alias("dst")))
    return graph.closure(back, edges.sparkSession.range(1).select(start.alias("node"))).where(F.col("node") != start).select("node")


def _membership(groups: DataFrame, options: DataFrame) -> list[DataFrame]:
    """Groups that list an option of another group, and options that their group does not list."""
    listed = groups.select(F.col("id").alias("lister"), F.explode("option_ids").alias("id")).distinct()
    own = options.select("id", "group_id")
    stray = listed.join(own, "id").where("group_id <> lister")
    known = own.join(groups.select(F.col("id").alias("group_id")).distinct(), "group_id", "left_semi")
    unlisted = known.join(listed.withColumnRenamed("lister", "group_id"), ["id", "group_id"], "left_anti")
    return [finding(stray, "variant-membership", "error", F.col("lister"), F.col("id").cast("string")), finding(unlisted, "variant-membership", "error", F.col("id"), F.col("group_id").cast("string"))]


def bible_findings(bible: Bible, format: str | None = None) -> DataFrame:
    """All findings (code, severity, subject, detail); with `format`, a bible whose table of one row `bible` has another format has that finding only.

    `initial_state` is a table of one row with an id. Null references and numbers are open, null texts are blank.
    """
    if format is not None and "bible" in bible:
        other = finding(bible["bible"].where(~F.col("format").eqNullSafe(F.lit(format))), "invalid-format", "error", F.col("id"), F.col("format"))
        if other.take(1):
            return other
    tables = {name: t for name, t in bible.items() if name != "bible"}
    out = [duplicates(t, "id") for name, t in tables.items() if "id" in t.columns and name != "initial_state"]
    out += _within(bible) + _lost(tables, tables)
    if "state_variables" in tables:
        out += _variables(tables, tables["state_variables"])
    for name, code, severity, wrong in _checks():
        if name in bible:
            try:
                bad = bible[name].where(F.coalesce(wrong, F.lit(False)))
            except AnalysisException:  # a column of the rule is absent: it cannot be checked, and that is said
                out.append(finding(bible[name].limit(1), "unchecked-rule", "warning", F.lit(name), code))
                continue
            out.append(finding(bad, code, severity, F.col("id"), "itself" if code == "continuity-cycle" else ""))
    if "continuities" in bible:
        out.append(finding(_into_cycles(bible["continuities"]), "continuity-cycle", "error", F.col("node")))
    if "variant_groups" in bible and "variant_options" in bible:
        out += _membership(bible["variant_groups"], bible["variant_options"])
    if _has(bible, "initial_state", "entity_locations.earliest"):
        at = bible["initial_state"].select(F.explode("entity_locations").alias("l")).select("l.*")
        late = ~_finite(F.col("earliest")) | ~_finite(F.col("latest")) | (F.col("earliest") > F.col("latest"))
        out.append(finding(at.where(late), "invalid-time-window", "error", F.concat(F.lit("initialState:"), "entity_id")))
    if "events" in bible:
        out.append(causal_order(bible["events"]))
    return union(out)


def decision_set_findings(bible: Bible, sets: DataFrame, bible_id: str, version: str, format: str | None = None) -> DataFrame:
    """Findings of many decision sets at once against one bible.

    sets (id, format, bible_id, bible_version, target_continuity_id, selected_option_ids, assume_proposition_ids, exclude_proposition_ids,
    variable_overrides, function_assignments, function_retirements). The subject is the set, or the group or option of a choice, with the
    set in the detail. A set of another format, or without a known target, has those findings only.
    """
    c = F.col
    ill = sets.where(~c("format").eqNullSafe(F.lit(format))) if format is not None else sets.limit(0)
    sets = sets.where(c("format").eqNullSafe(F.lit(format))) if format is not None else sets
    target = c("target_continuity_id")
    known = bible["continuities"].select(c("id").alias("target_continuity_id")).distinct()
    ok = sets.join(known, "target_continuity_id", "left_semi")
    own = {"decision_sets": ok}
    out = [
        finding(ill, "invalid-format", "error", c("id")) if format is not None else finding(ill, "invalid-format", "error", F.lit("")),
        finding(sets.where(F.trim(F.coalesce("id", F.lit(""))) == ""), "missing-text", "error", F.lit("decisionSet"), "decision_sets.id"),
        finding(sets.where(~c("bible_id").eqNullSafe(F.lit(bible_id))), "bible-mismatch", "error", c("id"), c("bible_id")),
        finding(sets.where(~c("bible_version").eqNullSafe(F.lit(version))), "bible-version-mismatch", "error", c("id"), c("bible_version")),
        finding(sets.join(known, "target_continuity_id", "left_anti"), "missing-reference", "error", c("id"), target),
        *_within(own),
        *_lost(own, bible),
        *_variables(own, bible["state_variables"]),
    ]
    edges = bible["continuities"].select(c("id").alias("src"), F.explode("inherits_from_ids").alias("dst"))
    reach = graph.closure(edges, ok.select(target.alias("node")).distinct())
    groups, options = bible["variant_groups"], bible["variant_options"]
    of_group = groups.select(c("id").alias("group_id"), F.explode("continuity_ids").alias("node")).join(reach, "node").select("group_id", c("start").alias("target_continuity_id")).distinct()
    scope = ok.select(c("id").alias("set_id"), "target_continuity_id").join(of_group, "target_continuity_id").select("set_id", "group_id")
    chosen = ok.select(c("id").alias("set_id"), F.explode("selected_option_ids").alias("id")).distinct()
    listed = groups.select(c("id").alias("group_id"), F.explode("option_ids").alias("id"))
    counts = chosen.join(listed, "id").groupBy("set_id", "group_id").agg(F.count("*").alias("n"))
    sized = scope.join(groups.select(c("id").alias("group_id"), "cardinality", F.size("option_ids").alias("of")), "group_id").join(counts, ["set_id", "group_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = c("cardinality")
    wrong = ((kind == "exactly-one") & (c("n") != 1)) | ((kind == "zero-or-one") & (c("n") > 1)) | ((kind == "one-or-more") & (c("n") < 1))
    held = chosen.join(options.select("id", "group_id", "requires_option_ids", "conflicts_with_option_ids"), "id")
    other = lambda column: held.select("set_id", c("id").alias("option"), F.explode(column).alias("id"))
    in_known = held.join(groups.select(c("id").alias("group_id")).distinct(), "group_id", "left_semi")
    detail = F.concat_ws(": ", c("set_id").cast("string"), c("id").cast("string"))
    return union(
        [
            *out,
            finding(sized.where(wrong), "variant-cardinality", "error", c("group_id"), F.format_string("%s: %s selected %d of %d", c("set_id").cast("string"), kind, c("n"), c("of"))),
            finding(other("requires_option_ids").join(chosen, ["set_id", "id"], "left_anti"), "missing-required-option", "error", c("option"), detail),
            finding(other("conflicts_with_option_ids").join(chosen, ["set_id", "id"], "left_semi"), "conflicting-option", "error", c("option"), detail),
            finding(in_known.join(scope, ["set_id", "group_id"], "left_anti"), "foreign-continuity-option", "error", c("id"), c("set_id").cast("string")),
        ]
    )


def causal_order(events: DataFrame) -> DataFrame:
    """Events (id, sequence, causal_parent_event_ids) that don't come after a parent."""
    child = events.select("id", "sequence", F.explode("causal_parent_event_ids").alias("parent"))
    parent = events.select(F.col("id").alias("parent"), F.col("sequence").alias("before"))
    return finding(child.join(parent, "parent").where("before >= sequence"), "causal-order", "error", F.col("id"), F.col("parent"))


def causal_time(events: DataFrame) -> DataFrame:
    """Events (id, earliest, latest, causal_parent_event_ids) against the time of their parents, over all events at once.

    `causal-time`: the parent cannot have come before; `causal-time-ambiguous`: it may have, as their ranges overlap. A range that is
    open where it matters is not found; parents that do not exist are `missing_reference`'s.
    """
    child = events.select("id", "earliest", "latest", F.explode(F.array_distinct("causal_parent_event_ids")).alias("parent"))
    parent = events.select(F.col("id").alias("parent"), F.col("earliest").alias("p_earliest"), F.col("latest").alias("p_latest"))
    both = child.join(parent, "parent")
    late = F.coalesce(F.col("p_earliest") > F.col("latest"), F.lit(False))
    maybe = both.where(~late & (F.col("p_latest") > F.col("earliest")))
    return union([finding(both.where(late), "causal-time", "error", F.col("id"), F.col("parent").cast("string")), finding(maybe, "causal-time-ambiguous", "warning", F.col("id"), F.col("parent").cast("string"))])


def decision_findings(groups: DataFrame, options: DataFrame, selected: DataFrame) -> DataFrame:
    """Findings of selected options (id): group cardinality, what they require and what conflicts.

    groups (id, selection: exactly-one, at-most-one or any), options (id, group_id, requires_option_ids, conflicts_with_option_ids).
    """
    known = options.select("id")
    chosen = options.join(selected.select("id").distinct(), "id", "left_semi")
    n = chosen.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n"))
    size = groups.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = ((F.col("selection") == "exactly-one") & (F.col("n") != 1)) | ((F.col("selection") == "at-most-one") & (F.col("n") > 1))
    return union(
        [
            finding(size.where(wrong), "group-cardinality", "error", F.col("id"), F.col("n").cast("string")),
            finding(selected.join(known, "id", "left_anti"), "unknown-option", "error", F.col("id")),
            missing_reference(chosen, "id", "requires_option_ids", selected, "id", "missing-required-option"),
            finding(
                chosen.select("id", F.explode("conflicts_with_option_ids").alias("other")).join(selected.select(F.col("id").alias("other")), "other", "left_semi"), "conflicting-option", "error", F.col("id"), F.col("other")
            ),
            duplicates(selected, "id", "duplicate-option"),
        ]
    )


FORBIDDEN = r"(?:^|[\s\"'(])(?:/home/|/Users/|/mnt/|file://|[A-Za-z]:\\)"


def forbidden_content(rows: DataFrame, subject: str, text: str, keys: tuple[str, ...] = ("text", "snippet", "privateText")) -> DataFrame:
    """Findings of JSON texts with a populated forbidden key at any depth, or a local path in them."""
    walk = rows.select(subject, text)
    v = walk.withColumn("_v", F.try_parse_json(text))
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.col(text).rlike(rf'"{k}"\s*:\s*(?!null|""|\[\]|\{{\}})')
    return union(
        [
            finding(v.where(F.col("_v").isNull()), "invalid-json", "error", F.col(subject)),
            finding(v.where(hit), "forbidden-key", "error", F.col(subject)),
            finding(v.where(F.col(text).rlike(FORBIDDEN)), "forbidden-path", "error", F.col(subject)),
        ]
    )
