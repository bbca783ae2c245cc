"""The transactional fold of `operators.canon` as keyed state: branches whose events come as rows.

A branch's world (bible without events, and decisions) is a row, each event another. State is kept by branch in the state
store: one entry for each slot of the state and one for each event seen, so a micro-batch loads the slots, looks up only
the events that its own name as causal parents, and writes back what it has touched. An event that finds an error is
undone by the fold's log and leaves no trace but its findings. Runs alike on a stream and on a table.

Defined cases: events that come before their world wait in the state for it; events of one batch are applied by sequence and id, later
batches after earlier ones, whatever their sequences; an event seen before is not applied again; events that are null, no
JSON or not of the branch's continuities are passed over; a world that comes again is ignored. A causal parent that has not
been seen counts as not active, also if it comes in a later batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tarnwick.operators.canon import Branch, State

OUT = "branch_id string, completed long, rolled_back long, findings array<struct<code:string,severity:string,subject:string,detail:string>>, propositions array<string>, variables map<string,double>, places map<string,string>, fulfilled map<string,string>"
SLOTS = ("entities", "propositions", "knowledge", "capabilities", "variables", "places", "resolved", "fulfilled")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _View:
    """Part of what is known of an event, looked up when asked for."""

    def __init__(self, of) -> None:
        self.of = of

    def __contains__(self, key: str) -> bool:
        return self.of(key) is not None

    def __getitem__(self, key: str):
        return self.of(key)


class KeptBranch(Branch):
    """A branch that goes on from slots, and asks `event` (id -> (done, earliest, latest) or None) about earlier events."""

    def __init__(self, world: dict, slots: dict[tuple[str, str], str] | None, event) -> None:
        super().__init__({**world["bible"], "events": []}, world["decisions"])
        self.first = slots is None
        if slots is not None:
            self.findings = []
            fresh, was = State(), [(k, x) for k in SLOTS for x in getattr(self.state, k)]
            for (kind, key), value in slots.items():
                at = tuple(json.loads(key)) if kind in ("knowledge", "capabilities") else key
                held = getattr(fresh, kind)
                value = json.loads(value)
                held.add(at) if isinstance(held, set) else held.update({at: tuple(value) if isinstance(value, list) else value})
            self.state = fresh
            self._refresh(fresh, [*was, *((k, x) for k in SLOTS for x in getattr(fresh, k))])
        self.touched: set[tuple[str, object]] = set()
        self.active_ids = _View(event)
        self.state.done = _View(lambda i: True if (event(i) or (False,))[0] else None)
        self.events = _View(lambda i: None if event(i) is None else {"time": dict(zip(("earliest", "latest"), event(i)[1:], strict=True))})

    def counts(self, e: dict) -> bool:
        """Whether an event is one of the branch, and on."""
        on = bool(e.get("enabledByDefault"))
        for o in self.options:
            on = (on or e["id"] in o["effects"].get("activateEventIds", [])) and e["id"] not in o["effects"].get("deactivateEventIds", [])
        return on and bool(self.inside & set(e.get("continuityIds", [])))

    def _finish(self, e: dict) -> None:
        self.touched.update((kind, key) for kind, key, _ in self.state.log)
        self.state.log.clear()

    def slots(self, all_: bool = False) -> Iterator[tuple[str, str, str | None]]:
        """(field, key, value as JSON or None) of what has been touched, or of the whole state."""
        keys = {(k, x) for k in SLOTS for x in getattr(self.state, k)} if all_ else self.touched
        for kind, key in keys:
            held = getattr(self.state, kind)
            value = None if key not in held else json.dumps(True if isinstance(held, set) else held[key])
            yield kind, json.dumps(list(key)) if isinstance(key, tuple) else key, value


class Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.world = handle.getValueState("world", "body string")
        self.numbers = handle.getValueState("numbers", "completed long, rolled_back long")
        self.slots = handle.getMapState("slots", "kind string, key string", "value string")
        self.events = handle.getMapState("events", "id string", "done boolean, earliest double, latest double")
        self.waiting = handle.getListState("waiting", "sequence long, body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        world, come = None, []
        for batch in rows:
            for kind, body in zip(batch["kind"], batch["body"], strict=True):
                try:
                    told = json.loads(body)
                except (TypeError, ValueError):
                    continue
                if kind == "world":
                    world = world or told
                elif isinstance(told, dict) and told.get("id") is not None:
                    come.append(told)
        known = self.world.exists()
        if not known and world is None:
            for e in come:
                self.waiting.appendValue((int(e["sequence"]), json.dumps(e)))
            return
        if not known:
            self.world.update((json.dumps(world),))
            come += [json.loads(body) for _, body in self.waiting.get()]
            self.waiting.clear()
        asked: dict[str, tuple | None] = {}

        def event(i: str) -> tuple | None:
            if i not in asked:
                asked[i] = tuple(self.events.getValue((i,))) if self.events.containsKey((i,)) else None
            return asked[i]

        held = {(k[0], k[1]): v[0] for k, v in self.slots.iterator()} if known else None
        branch = KeptBranch(json.loads(self.world.get()[0]), held, event)
        completed, back = self.numbers.get() if self.numbers.exists() else (0, 0)
        for e in sorted(come, key=lambda e: (e["sequence"], e["id"])):
            if event(e["id"]) is None and branch.counts(e):
                asked[e["id"]] = (False, float(e["time"]["earliest"]), float(e["time"]["latest"]))
                done = branch.step(e)
                asked[e["id"]] = (done, *asked[e["id"]][1:])
                self.events.updateValue((e["id"],), asked[e["id"]])
                completed, back = completed + done, back + (not done)
        self.numbers.update((completed, back))
        for kind, at, value in branch.slots(not known):
            if value is None:
                self.slots.removeKey((kind, at))
            else:
                self.slots.updateValue((kind, at), (value,))
        s = branch.state
        found = [dict(zip(("code", "severity", "subject", "detail"), f, strict=True)) for f in branch.findings]
        yield pd.DataFrame({
            "branch_id": [key[0]], "completed": [completed], "rolled_back": [back], "findings": [found], "propositions": [sorted(s.propositions)], "variables": [{k: float(v) for k, v in sorted(s.variables.items())}],
            "places": [{k: v[0] for k, v in sorted(s.places.items())}], "fulfilled": [{k: v[0] for k, v in sorted(s.fulfilled.items())}],
        })

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs Spark's RocksDB store, and on a table too what coordinates stores for streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active


def fold_rows(rows: DataFrame) -> DataFrame:
    """What each branch has come to: rows (branch_id, kind: world or event, body: JSON), a stream or a table.

    A world is {"bible": ..., "decisions": ...}. One row for each branch and batch: completed and rolled_back count all
    events so far, findings are the batch's own.
    """
    use_rocksdb(rows.sparkSession)
    keyed = rows.select("branch_id", "kind", "body").groupBy("branch_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=OUT, outputMode="Update", timeMode="None")
