"""SQL rules over streams whose rows depend on earlier ones.

Functions of earlier rows, and windows by count, state or row, keep their state in ``transformWithState``; a
window's rows come out together, in the micro-batch that completes it.  What follows in the rule
(lookups, conditions, aggregates, order) then concerns rows of one micro-batch alone, and is planned over each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Compiler
from ..plans.frame import TIME, WINDOW, Frame, PlanProblem
from ..sql import tree as t
from ..sql.parser import unit_ms
from .stateful import fold

_KEPT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_PLAIN = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType)
WINDOWS = {"count", "state", "sliding"}


def _key(columns: list[Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])) if columns else F.lit("all")


def _call_step(calls: list[dict]):
    """One row through the state of all calls."""

    def changed(s: dict, values: list, skip: bool) -> bool:
        hit = False
        for i, v in enumerate(values):
            if skip and v is None:
                continue
            hit |= str(i) not in s or s[str(i)] != v
            s[str(i)] = v
        return hit

    def step(state: dict, row: dict) -> Iterator[dict]:
        out = dict(row)
        for c in calls:
            s, ok = state.setdefault(c["out"], {}), bool(row[c["when"]]) if c["when"] else True
            args = [row[a] for a in c["args"]]
            if c["name"] == "lag":
                q = s.setdefault("q", [])
                out[c["out"]] = q[0] if len(q) == c["offset"] else c["default"]
                if ok and (args[0] is not None or not c["skip"]):
                    s["q"] = [*q, args[0]][-c["offset"] :]
            elif c["name"] == "latest":
                if ok and args[0] is not None:
                    s["v"] = args[0]
                out[c["out"]] = s.get("v") if s.get("v") is not None else c["default"]
            elif c["name"] == "changed_col":
                out[c["out"]] = args[0] if ok and changed(s, args, c["skip"]) else None
            elif c["name"] == "had_changed":
                out[c["out"]] = ok and changed(s, args, c["skip"])
            else:
                if not s or s["over"]:
                    s.update({"on": len(args) == 1, "over": False, "n": 0, "s": 0.0, "lo": None, "hi": None})
                s["on"] = s["on"] or (len(args) == 3 and bool(args[1]))
                if ok and s["on"] and args[0] is not None:
                    x = args[0]
                    s.update({"n": s["n"] + 1, "s": s["s"] + x, "lo": x if s["lo"] is None else min(s["lo"], x), "hi": x if s["hi"] is None else max(s["hi"], x)})
                s["over"] = len(args) == 3 and bool(args[2])
                out[c["out"]] = {"sum": float(s["s"]), "count": s["n"], "avg": s["s"] / s["n"] if s["n"] else 0.0, "max": float(s["hi"] or 0), "min": float(s["lo"] or 0)}[c["name"].removeprefix("acc_")]
        yield out

    return step


def earlier_rows(planner, q: t.Select, frame: Frame, calls: list[t.Call], names: dict) -> tuple[t.Select, Frame]:
    """``q`` with its calls as columns, and the stream that has these columns."""
    if frame.time is None:
        raise PlanProblem("functions of earlier rows need a stream with a time")
    put: dict[t.Call, t.Node] = {}
    columns = list(frame.columns)
    for group in dict.fromkeys(c.partition for c in calls):
        df, made, fields, kinds = frame.df, [], [], {}
        comp = Compiler(frame, names, planner.properties)
        base = len(put)
        for i, c in enumerate((c for c in calls if c.partition == group), base):
            if c.name == "changed_cols":
                raise PlanProblem("changed_cols is for bounded rows; name the columns with changed_col")
            lit = lambda j, d=None, c=c: c.args[j].value if len(c.args) > j and isinstance(c.args[j], t.Lit) else d
            if c.name == "had_changed":
                given = [F.col(f"`{n}`") for _, _, n in frame.columns if not n.startswith("_")] if isinstance(c.args[1], t.Star) else [comp.column(a) for a in c.args[1:]]
            elif c.name == "changed_col":
                given = [comp.column(c.args[1])]
            elif c.name in ("lag", "latest"):
                given = [comp.column(c.args[0])]
            else:
                given = [F.lit(1) if isinstance(c.args[0], t.Star) else comp.column(c.args[0]), *(comp.condition(a) for a in c.args[1:3])]
            at = [f"_a{i}_{j}" for j in range(len(given))]
            shown = df.select(*[g.alias(n) for g, n in zip(given, at, strict=True)]).schema
            # What JSON can't hold as it is goes through the state as text.
            df = df.withColumns({n: g if isinstance(shown[n].dataType, _PLAIN) else F.to_json(F.struct(g.alias("v")), _KEPT) for g, n in zip(given, at, strict=True)})
            when = f"_when{i}" if c.when is not None else None
            if when:
                df = df.withColumn(when, comp.condition(c.when))
            kind = T.BooleanType() if c.name == "had_changed" else T.LongType() if c.name == "acc_count" else T.DoubleType() if c.name.startswith("acc_") else shown[at[0]].dataType
            name = f"_f{i}"
            kinds[name] = kind
            made.append({"name": c.name, "out": name, "args": at, "when": when, "offset": lit(1, 1), "skip": lit(0) if c.name in ("changed_col", "had_changed") else lit(3, True), "default": lit(2) if c.name == "lag" else lit(1)})
            put[c] = t.Name(name)
        df = df.withColumn("_key", _key([comp.column(k) for k in group]))
        fields = [*df.schema.fields, *(T.StructField(n, k if isinstance(k, _PLAIN) else T.StringType()) for n, k in kinds.items())]
        df = fold(df, ["_key"], [TIME, "_o"], _call_step(made), T.StructType(fields))
        for n, k in kinds.items():
            if not isinstance(k, _PLAIN):
                df = df.withColumn(n, F.from_json(n, T.StructType([T.StructField("v", k)]), _KEPT)["v"])
            columns.append(("", n, n))
        hidden = ("_a", "_when", "_key")
        frame = Frame(df.select(*[f"`{c}`" for c in df.columns if not c.startswith(hidden)]), tuple(columns))
    return t.rewrite(q, lambda n: put.get(n, n) if isinstance(n, t.Call) else n), frame


def _count_step(n: int, every: int):
    def step(state: dict, row: dict) -> Iterator[dict]:
        state["q"] = [*state.get("q", []), [row["_t"], row["_j"]]][-n:]
        state["i"] = state.get("i", 0) + 1
        if state["i"] % every == 0 and len(state["q"]) == n:
            yield from _window(row, state["q"], state["q"][0][0], row["_t"], state["i"])

    return step


def _state_step(ends: bool):
    def step(state: dict, row: dict) -> Iterator[dict]:
        q, at = state.get("q"), [row["_t"], row["_j"]]
        if not ends and row["_b"]:
            if q is not None:
                state["i"] = state.get("i", 0) + 1
                yield from _window(row, q, q[0][0], q[-1][0], state["i"])
            q = []
        elif ends and q is None and row["_b"]:
            q = []
        if q is not None:
            q.append(at)
            if ends and row["_e"]:
                state["i"] = state.get("i", 0) + 1
                yield from _window(row, q, q[0][0], q[-1][0], state["i"])
                q = None
        state["q"] = q

    return step


def _sliding_step(ms: int, delay: int):
    def step(state: dict, row: dict) -> Iterator[dict]:
        now, q, waiting = row["_t"], state.get("q", []), state.get("w", [])
        for at, i in [w for w in waiting if w[0] + delay <= now]:
            yield from _window(row, [e for e in q if at - ms <= e[0] < at + delay], at - ms, at + delay, i)
        waiting = [w for w in waiting if w[0] + delay > now]
        oldest = min([now, *(w[0] for w in waiting)])
        q = [*(e for e in q if e[0] >= oldest - ms), [now, row["_j"]]]
        if row["_b"]:
            state["i"] = state.get("i", 0) + 1
            if delay:
                waiting.append([now, state["i"]])
            else:
                yield from _window(row, [e for e in q if e[0] >= now - ms], now - ms, now, state["i"])
        state["q"], state["w"] = q, waiting

    return step


def _window(row: dict, held: list, start: int, end: int, number: int) -> Iterator[dict]:
    for _, body in held:
        yield {"_j": body, "_s": start, "_z": end, "_n": number, "_k": row["_k"]}


def windowed(planner, q: t.Select, frame: Frame, names: dict) -> Frame:
    """The rows of each window that is complete, with the window."""
    if frame.time is None:
        raise PlanProblem("a window needs a stream with a time")
    w, comp, df = q.window, Compiler(frame, names, planner.properties), frame.df
    if w.where is not None:
        df = df.filter(comp.condition(w.where))
    n, unit = [a.value for a in w.args if isinstance(a, t.Lit)], unit_ms(w.unit) if w.unit else 1
    begin, emit = F.lit(True), F.lit(False)
    if w.kind == "count":
        step = _count_step(n[0], n[1] if len(n) > 1 else n[0])
    elif w.kind == "sliding":
        step, begin = _sliding_step(n[0] * unit, n[1] * unit if len(n) > 1 else 0), F.lit(True) if w.when is None else comp.condition(w.when)
    else:
        step, begin = _state_step(len(w.args) > 1), comp.condition(w.args[0])
        emit = comp.condition(w.args[1]) if len(w.args) > 1 else emit
    schema = df.schema
    rows = df.select(_key([comp.column(k) for k in w.partition]).alias("_k"), F.unix_millis(TIME).alias("_t"), F.col("_o").alias("_at"), F.to_json(F.struct(*df.columns), _KEPT).alias("_j"), F.coalesce(begin, F.lit(False)).alias("_b"), F.coalesce(emit, F.lit(False)).alias("_e"))
    out = fold(rows, ["_k"], ["_t", "_at"], step, "_j string, _s bigint, _z bigint, _n bigint, _k string")
    span = F.struct(F.timestamp_millis("_s").alias("start"), F.timestamp_millis("_z").alias("end"), F.col("_n").alias("number"), F.col("_k").alias("key"))
    return frame.with_df(out.select(F.from_json("_j", schema, _KEPT).alias("_r"), span.alias(WINDOW)).select("_r.*", WINDOW))


def needed(q: t.Select, row_calls: set[str]) -> bool:
    """Whether a rule's stream needs what is here."""
    return (q.window is not None and q.window.kind in WINDOWS) or any(isinstance(n, t.Call) and n.name in row_calls for n in q.walk())
