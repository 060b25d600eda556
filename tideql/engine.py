"""Streams, tables and rules of one Spark session."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import schedule
from .functions import AGGREGATES, ANALYTIC
from .plans.frame import PlanProblem
from .plans.planner import Planner
from .sources import readers, sinks
from .sql import tree as t
from .sql.parser import parse


#: Rules of a shared read whose jobs are given to Spark at once.
SIDE_BY_SIDE = 8


def session(name: str = "tideql", **conf: str) -> SparkSession:
    """A session with the settings that rules rely on; the cluster's own stay."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@dataclass
class Rule:
    id: str
    sql: str | None = None
    graph: dict | None = None
    actions: list[dict] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    query: Any = None
    status: str = "stopped"
    checkpoint: str | None = None
    #: Of rules that share a read: their names, and the stream.
    group: tuple[str, list[str]] | None = None
    #: Restarts after errors since it was started, and when the next is due.
    attempts: int = 0
    due: float | None = None


class Engine:
    def __init__(self, spark: SparkSession, properties: dict | None = None):
        self.spark, self.properties = spark, dict(properties or {})
        self.definitions: dict[str, t.Definition] = {}
        self.frames: dict[str, tuple[str, DataFrame]] = {}
        self.rules: dict[str, Rule] = {}
        self.lazy: dict[str, Callable[[], Engine]] = {}

    # --- definitions

    def register(self, name: str, df: DataFrame, time: str | None = None, kind: str = "stream", retain: int | None = None) -> Engine:
        """Use a DataFrame as a stream, or as a table of which the last ``retain`` rows count."""
        df = readers.timed(df, time) if time else df
        self.frames[name.lower()] = (kind, readers.retained(df, retain) if retain else df)
        return self

    def attach(self, name: str, open_: Callable[[], DataFrame], time: str | None = None, kind: str = "stream") -> Engine:
        """As ``register``, for a DataFrame that is made when a rule first names it."""
        self.lazy[name.lower()] = lambda: self.register(name, open_(), time, kind)
        return self

    def source(self, name: str, streaming: bool = False) -> tuple[str, DataFrame]:
        key = name.lower()
        if key in self.lazy:
            self.lazy.pop(key)()
        if key in self.frames:
            return self.frames[key]
        if key not in self.definitions:
            raise PlanProblem(f"unknown stream or table {name}")
        d = self.definitions[key]
        df = readers.read(self.spark, d, streaming and d.kind == "stream")
        if d.kind == "table" and "RETAIN_SIZE" in d.options:
            df = readers.retained(df, int(d.options["RETAIN_SIZE"]))
        if streaming and d.kind == "stream" and "_ts" in df.columns:
            df = df.withWatermark("_ts", f"{int(self.properties.get('lateTolerance', 1000))} milliseconds")
        return d.kind, df

    def sql(self, text: str, streaming: bool = False) -> DataFrame:
        """Run one statement.  SELECT and SHOW give rows, DESCRIBE and EXPLAIN text in rows; the others an empty result."""
        node = parse(text)
        if isinstance(node, t.Select):
            return self.planner(streaming=streaming).plan(node)
        if isinstance(node, t.Definition):
            if node.name.lower() in self.definitions or node.name.lower() in self.frames:
                raise PlanProblem(f"{node.name} is there already")
            self.definitions[node.name.lower()] = node
            return self._rows([])
        names = {**{k: d.kind for k, d in self.definitions.items()}, **{k: v[0] for k, v in self.frames.items()}}
        if node.action == "show":
            return self._rows(sorted(n for n, k in names.items() if k == node.kind))
        key = node.name.lower()
        if names.get(key) != node.kind:
            raise PlanProblem(f"no {node.kind} {node.name}")
        if node.action == "drop":
            self.definitions.pop(key, None)
            self.frames.pop(key, None)
            return self._rows([])
        df = self.source(node.name)[1]
        if node.action == "describe":
            return self._rows([f"{n} {k}" for n, k in df.dtypes if not n.startswith("_")])
        return self._rows(df._jdf.queryExecution().toString().split("\n"))

    def _rows(self, lines: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in lines], "result string")

    def planner(self, rule_id: str | None = None, streaming: bool = False) -> Planner:
        return Planner(lambda n: self.source(n, streaming), self.properties | {"rule_id": rule_id, "rule_start": int(time.time() * 1000)})

    def explain(self, text: str) -> str:
        return self.sql(text)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def validate(self, text: str) -> str | None:
        """What is wrong with a rule's SQL, or None."""
        try:
            self.sql(text)
        except Exception as e:  # whatever it is, it is the answer
            return str(e)
        return None

    def trial(self, text: str, rows: dict[str, tuple[list[dict], str, str | None]]) -> list[dict]:
        """A rule's result on mock rows: for each source the rows, their schema and the time's column."""
        other = Engine(self.spark, self.properties)
        for name, (data, schema, when) in rows.items():
            other.register(name, readers.simulator(self.spark, data, schema), when)
        for k, v in self.frames.items():
            other.frames.setdefault(k, v)
        return [r.asDict(True) for r in other.sql(text).collect()]

    # --- rules

    def create_rule(self, rule: dict | str) -> Rule:
        rule = json.loads(rule) if isinstance(rule, str) else rule
        if rule["id"] in self.rules:
            raise PlanProblem(f"rule {rule['id']} is there already")
        r = Rule(rule["id"], rule.get("sql"), rule.get("graph"), rule.get("actions", []), rule.get("options", {}))
        self.result(r)  # what can't be planned is refused
        self.rules[r.id] = r
        return r

    def result(self, r: Rule, streaming: bool = False) -> DataFrame:
        if r.graph:
            from .graph import build

            return build(self, r.graph, streaming)
        return self._planner_of(r, streaming).plan(parse(r.sql))

    def _planner_of(self, r: Rule, streaming: bool) -> Planner:
        other = Engine(self.spark, self.properties | r.options)
        other.definitions, other.frames, other.lazy = self.definitions, self.frames, self.lazy
        return other.planner(r.id, streaming)

    def run(self, rule_id: str) -> None:
        """Do a rule's actions once, over all that its bounded sources have; several actions share the rows."""
        r = self.rules[rule_id]
        df = self.result(r)
        if len(r.actions) > 1:
            df = df.persist()
        for action in r.actions:
            for kind, options in action.items():
                sinks.write(df, kind, options)
        if len(r.actions) > 1:
            df.unpersist()

    def start(self, rule_id: str, checkpoint: str, available_now: bool = True):
        """Run a rule as a streaming query; each micro-batch goes to all its actions."""
        r = self.rules[rule_id]
        kept = self._planner_of(r, True).streamed(parse(r.sql)) if r.sql else None
        df, finish = kept or (self.result(r, streaming=True), lambda batch: batch)

        def each(batch: DataFrame, _: int) -> None:
            batch = finish(batch).persist()
            for action in r.actions:
                for kind, options in action.items():
                    sinks.write(batch, kind, options)
            batch.unpersist()

        writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        r.query = (writer.trigger(availableNow=True) if available_now else writer).start()
        r.status, r.checkpoint, r.group, r.attempts, r.due = "running", checkpoint, None, 0, None
        return r.query

    def start_shared(self, source: str, rule_ids: list[str], checkpoint: str, available_now: bool = True):
        """Run rules without state over one read of a stream: each micro-batch is read once and goes through every rule."""
        rules = [self.rules[i] for i in rule_ids]
        for r in rules:
            q = parse(r.sql)
            if q.source.lower() != source.lower() or q.window or q.dims or any(isinstance(n, t.Call) and (n.name in AGGREGATES or n.name in ANALYTIC) for n in q.walk()):
                raise PlanProblem(f"rule {r.id} does not map rows of {source} one by one")
        kind, df = self.source(source, streaming=True)

        def each(batch: DataFrame, _: int) -> None:
            batch = batch.persist()

            def one(r: Rule) -> None:
                other = Engine(self.spark, self.properties | r.options)
                other.definitions, other.frames, other.lazy = self.definitions, self.frames | {source.lower(): (kind, batch)}, self.lazy
                out = other.planner(r.id).plan(parse(r.sql))
                for action in r.actions:
                    for how, options in action.items():
                        sinks.write(out, how, options)

            with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:  # one rule's last tasks leave cores to the next
                list(pool.map(one, rules))
            batch.unpersist()

        writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if available_now else writer).start()
        for r in rules:
            r.query, r.status, r.checkpoint, r.group, r.attempts, r.due = query, "running", checkpoint, (source, list(rule_ids)), 0, None
        return query

    def patrol(self) -> list[str]:
        """Start again the rules that an error ended, once their pause is over; their names.

        restartStrategy: ``attempts`` in all, the first after ``delay`` ms, each further one after ``multiplier``
        times as long, ``maxDelay`` at most.  Rules that share a read are started together.
        """
        again: list[str] = []
        for r in list(self.rules.values()):
            if r.status == "running" and r.query is not None and not r.query.isActive and r.query.exception() is not None:
                how = r.options.get("restartStrategy", {})
                r.status, r.due = "failed", None
                if r.attempts < how.get("attempts", 0):
                    pause = min(how.get("delay", 0) * how.get("multiplier", 1) ** r.attempts, how.get("maxDelay", 30_000))
                    r.due = time.monotonic() + pause / 1000
            if r.status == "failed" and r.due is not None and r.due <= time.monotonic():
                members = self.rules[r.id].group
                names, done = (members[1], r.attempts + 1) if members else ([r.id], r.attempts + 1)
                if members:
                    self.start_shared(members[0], members[1], r.checkpoint)
                else:
                    self.start(r.id, r.checkpoint)
                for name in names:
                    self.rules[name].attempts, self.rules[name].due = done, None
                again += names
        return again

    def tick(self, now: float | None = None) -> list[str]:
        """Start and stop rules by their schedules, as of a time in seconds; the names of those that now run.

        ``cron`` (minute hour day month weekday) with ``duration`` starts a rule at each match; ``cronDatetimeRange``
        lists [begin, end] times outside of which it rests, by itself or beside ``cron``.
        """
        now = time.time() if now is None else now
        for r in self.rules.values():
            if not (r.options.get("cron") or r.options.get("cronDatetimeRange")):
                continue
            due = schedule.due(r.options, now)
            active = r.query is not None and r.query.isActive
            if due and not active:
                self.start(r.id, r.options["checkpoint"], available_now=False)
            elif not due and active:
                self.stop(r.id)
        return [r.id for r in self.rules.values() if r.query is not None and r.query.isActive]

    def reset_state(self, rule_id: str) -> None:
        """Forget a stopped rule's offsets and state."""
        r = self.rules[rule_id]
        self.stop(rule_id)
        if r.checkpoint:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(r.checkpoint)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def stop(self, rule_id: str) -> None:
        r = self.rules[rule_id]
        if r.query is not None:
            r.query.stop()
        r.status = "stopped"

    def state(self, rule_id: str) -> dict:
        r = self.rules[rule_id]
        running = r.query is not None and r.query.isActive
        return {"id": r.id, "status": "running" if running else "stopped", "progress": r.query.lastProgress if r.query is not None else None}

    def drop_rule(self, rule_id: str) -> None:
        self.stop(rule_id)
        del self.rules[rule_id]

    def export(self) -> str:
        """Definitions and rules as JSON that ``load`` takes."""
        return json.dumps({"streams": [d.text for d in self.definitions.values()], "rules": [{"id": r.id, "sql": r.sql, "graph": r.graph, "actions": r.actions, "options": r.options} for r in self.rules.values()]})

    def load(self, text: str) -> None:
        data = json.loads(text)
        for s in data["streams"]:
            self.sql(s)
        for r in data["rules"]:
            self.create_rule(r)
