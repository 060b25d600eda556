"""Streaming forms of what depends on earlier rows, over ``transformWithState``.

Tumbling, hopping and session windows, joins and filters need none of this: a rule over a
stream is planned as for bounded data, and Spark keeps their state.  Here are functions of
earlier rows and windows by count, state or row.  State is kept by key in the state store as
one small JSON value; rows of a micro-batch are taken in time order, and rows later than the
watermark are Spark's to drop.  A stream without keys has one key, as its definition has it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[dict, dict], Iterator[dict]]


class _Fold(StatefulProcessor):
    """Runs ``step(state, row)`` over the rows of a key in order; it changes the state and yields rows."""

    def __init__(self, step: Step, order: list[str], names: list[str]):
        self.step, self.order, self.names = step, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        found = self.kept.get() if self.kept.exists() else None
        state = json.loads(found[0]) if found else {}
        for row in sorted((r.asDict() for r in rows), key=lambda r: tuple(r[c] for c in self.order)):
            for out in self.step(state, row):
                yield Row(**{n: out.get(n) for n in self.names})
        self.kept.update((json.dumps(state, default=str),))

    def close(self) -> None:
        pass


def fold(df: DataFrame, keys: list[str], order: list[str], step: Step, schema: T.StructType | str) -> DataFrame:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not keys:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    return df.groupBy(*keys).transformWithState(statefulProcessor=_Fold(step, order, schema.names), outputStructType=schema, outputMode="Append", timeMode="None")


def row_functions(df: DataFrame, order: list[str], calls: dict[str, tuple], keys: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each call: ("lag", column, offset, default), ("latest", column), ("changed", column, skip_null), ("had_changed", [columns], skip_null).

    A fourth (or later) entry that is callable is WHEN: rows that it refuses read the state and leave it.
    """
    kinds = {f.name: f.dataType for f in df.schema}

    def step(state: dict, row: dict) -> Iterator[dict]:
        out = dict(row)
        for name, (kind, column, *more) in calls.items():
            when = next((m for m in more if callable(m)), None)
            more = [m for m in more if not callable(m)]
            ok = when is None or bool(when(row))
            s = state.setdefault(name, {"q": [], "seen": False, "v": None, "each": {}})
            if kind == "lag":
                offset, default = (more + [1, None][len(more) :])[:2]
                out[name] = s["q"][0] if len(s["q"]) == offset else default
                if ok and row[column] is not None:
                    s["q"] = [*s["q"], row[column]][-offset:]
            elif kind == "latest":
                if ok and row[column] is not None:
                    s["v"] = row[column]
                out[name] = s["v"] if s["v"] is not None else (more[0] if more else None)
            else:
                each, skip = ([column], more[0]) if kind == "changed" else (column, more[0])
                hit = False
                for c in each:
                    if not ok or (skip and row[c] is None):
                        continue
                    hit |= s["each"].get(c) != row[c]
                    s["each"][c] = row[c]
                out[name] = (row[column] if hit else None) if kind == "changed" else hit
        yield out

    def of(kind: str, column) -> T.DataType:
        return T.BooleanType() if kind == "had_changed" else kinds[column]

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, of(c[0], c[1])) for n, c in calls.items()]])
    return fold(df, keys or [], order, step, schema)


def accumulate(df: DataFrame, order: list[str], column: str, kinds: list[str], keys: list[str] | None = None, begin=None, reset=None) -> DataFrame:
    """``df`` with acc_sum, acc_count, acc_avg, acc_max and acc_min of a column, as asked; counted from a ``begin`` row on, up to a ``reset`` row."""

    def step(state: dict, row: dict) -> Iterator[dict]:
        if not state or state.get("over"):
            state.update({"on": begin is None, "over": False, "n": 0, "s": 0.0, "lo": None, "hi": None})
        state["on"] = state["on"] or bool(begin and begin(row))
        x = row[column]
        if state["on"] and x is not None:
            state.update({"n": state["n"] + 1, "s": state["s"] + x, "lo": x if state["lo"] is None else min(state["lo"], x), "hi": x if state["hi"] is None else max(state["hi"], x)})
        state["over"] = bool(reset and reset(row))
        values = {"sum": state["s"], "count": state["n"], "avg": state["s"] / state["n"] if state["n"] else 0.0, "max": float(state["hi"] or 0), "min": float(state["lo"] or 0)}
        yield row | {f"acc_{k}": values[k] for k in kinds}

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"acc_{k}", T.LongType() if k == "count" else T.DoubleType()) for k in kinds]])
    return fold(df, keys or [], order, step, schema)


def _aggregated(rows: list[Any], kinds: dict[str, str]) -> dict:
    found = [x for x in rows if x is not None]
    known = {"count": len(rows), "sum": sum(found), "min": min(found, default=None), "max": max(found, default=None)}
    return {name: known[kind] for name, kind in kinds.items()}


def _windows(df: DataFrame, order: list[str], column: str, out: dict[str, str], keys, step: Step) -> DataFrame:
    kind = {f.name: f.dataType for f in df.schema}
    shared = [T.StructField(k, kind[k]) for k in keys or []]
    fields = [T.StructField(n, T.LongType() if k == "count" else kind[column]) for n, k in out.items()]
    return fold(df, keys or [], order, step, T.StructType([*shared, *fields]))


def count_window(df: DataFrame, order: list[str], column: str, out: dict[str, str], n: int, every: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Aggregates of the last ``n`` rows at each ``every``-th row."""
    every = every or n

    def step(state: dict, row: dict) -> Iterator[dict]:
        state["q"] = [*state.get("q", []), row[column]][-n:]
        state["i"] = state.get("i", 0) + 1
        if state["i"] % every == 0 and len(state["q"]) == n:
            yield {k: row[k] for k in keys or []} | _aggregated(state["q"], out)

    return _windows(df, order, column, out, keys, step)


def state_window(df: DataFrame, order: list[str], column: str, out: dict[str, str], begin, emit=None, keys: list[str] | None = None) -> DataFrame:
    """Aggregates from a ``begin`` row to an ``emit`` row; without ``emit``, from each ``begin`` row to before the next."""

    def step(state: dict, row: dict) -> Iterator[dict]:
        key, q = {k: row[k] for k in keys or []}, state.get("q")
        if emit is None and begin(row):
            if q is not None:
                yield key | _aggregated(q, out)
            q = []
        elif emit is not None and q is None and begin(row):
            q = []
        if q is not None:
            q.append(row[column])
            if emit is not None and emit(row):
                yield key | _aggregated(q, out)
                q = None
        state["q"] = q

    return _windows(df, order, column, out, keys, step)


def sliding_window(df: DataFrame, time: str, column: str, out: dict[str, str], ms: int, keys: list[str] | None = None, trigger=None) -> DataFrame:
    """Aggregates of the rows in [t - ms, t] at each row, or at each that ``trigger`` holds for; ``time`` is in milliseconds."""

    def step(state: dict, row: dict) -> Iterator[dict]:
        state["q"] = [e for e in state.get("q", []) if e[0] >= row[time] - ms] + [[row[time], row[column]]]
        if trigger is None or trigger(row):
            yield {k: row[k] for k in keys or []} | _aggregated([e[1] for e in state["q"]], out)

    return _windows(df, [time], column, out, keys, step)


def dedup_spans(df: DataFrame, start: str, end: str, keys: list[str] | None = None, horizon: int | None = None) -> DataFrame:
    """dedup_trigger: of each time span, in order of its end, the parts that no earlier one has covered; spans without any give no row.

    Covered spans that end ``horizon`` ms before the newest are forgotten.
    """

    def step(state: dict, row: dict) -> Iterator[dict]:
        parts, at = [], row[start]
        for a, b in state.get("c", []):
            if b <= at or a >= row[end]:
                continue
            if a > at:
                parts.append((at, a))
            at = max(at, b)
        if at < row[end]:
            parts.append((at, row[end]))
        merged: list[list[int]] = []
        for a, b in sorted([*state.get("c", []), [row[start], row[end]]]):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        state["c"] = [m for m in merged if horizon is None or m[1] >= row[end] - horizon]
        if parts:
            yield row | {"parts": [Row(start_key=a, end_key=b) for a, b in parts]}

    kind = T.ArrayType(T.StructType([T.StructField("start_key", T.LongType()), T.StructField("end_key", T.LongType())]))
    return fold(df, keys or [], [end, start], step, T.StructType([*df.schema.fields, T.StructField("parts", kind)]))
