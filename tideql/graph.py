"""Rules given as a graph of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import sampling, windows
from .plans.compiler import Compiler
from .plans.frame import WINDOW, Frame, PlanProblem
from .sources.readers import placed
from .sql import tree as t
from .sql.parser import parse_expr, unit_ms


def _frame(df: DataFrame, name: str = "self") -> Frame:
    return Frame(df, tuple((name, c, c) for c in df.columns if not c.startswith("_")))


def _alias(text: str) -> tuple[t.Node, str]:
    low = text.lower()
    if " as " in low:
        i = low.rindex(" as ")
        return parse_expr(text[:i]), text[i + 4 :].strip()
    node = parse_expr(text)
    return node, getattr(node, "name", "value")


def _window(df: DataFrame, p: dict, properties: dict) -> DataFrame:
    unit, size = unit_ms(p.get("unit", "ms").lower()), p.get("size")
    kind = p["type"].lower().removesuffix("window")
    if kind == "tumbling":
        return windows.tumbling(df, size * unit)
    if kind == "hopping":
        return windows.hopping(df, size * unit, p["interval"] * unit)
    if kind == "session":
        return windows.sessions(df, p["interval"] * unit, size * unit)
    df = placed(df)
    if kind == "sliding":
        return windows.sliding(df, size * unit, p.get("interval", 0) * unit, None, "_o")
    if kind == "count":
        return windows.counts(df, size, p.get("interval"), [], [F.col("_ts"), F.col("_o")])
    if kind == "state":
        condition = lambda e: None if e is None else Compiler(_frame(df), {}, properties).condition(parse_expr(e))
        return windows.states(df, condition(p["begin"]), condition(p.get("emit")), [], [F.col("_ts"), F.col("_o")])
    raise PlanProblem(f"unknown window {p['type']!r}")


def build(engine, graph: dict, streaming: bool = False) -> DataFrame:
    """The one result of a graph that reaches a sink, or an operator that nothing follows."""
    nodes, edges = graph["nodes"], graph["topo"]["edges"]
    before: dict[str, list[tuple[str, int | None]]] = {n: [] for n in nodes}
    for a, outs in edges.items():
        for i, b in enumerate(outs):
            for one in b if isinstance(b, list) else [b]:
                before[one].append((a, i if isinstance(b, list) else None))
    done: dict[str, object] = {}

    def value(name: str):
        if name not in done:
            done[name] = make(name)
        return done[name]

    def inputs(name: str) -> list[DataFrame]:
        out = []
        for a, port in before[name]:
            got = value(a)
            out.append(got[port or 0] if isinstance(got, list) else got)
        return out

    def make(name: str):
        node, p = nodes[name], nodes[name].get("props", {})
        if node["type"] == "source":
            return engine.source(p.get("sourceName", name), streaming)[1]
        frames = inputs(name)
        if node["type"] == "sink":
            return frames[0]
        df, kind = frames[0], node["nodeType"].lower()
        keys = getattr(df, "_tideql_groups", [])
        comp = Compiler(_frame(df), {}, engine.properties)
        if kind == "watermark":
            for x in frames[1:]:
                df = df.unionByName(x, allowMissingColumns=True)
            late = p.get("lateTolerance", engine.properties.get("lateTolerance", 1000))
            return df.withWatermark("_ts", f"{int(late)} milliseconds") if df.isStreaming and "_ts" in df.columns else df
        if kind == "function":
            node_, label = _alias(p["expr"])
            return df.withColumn(label, comp.column(node_))
        if kind == "filter":
            return df.filter(comp.condition(parse_expr(p["expr"])))
        if kind == "pick":
            fields = [f.replace(" ", "") if "(" not in f else f for f in p["fields"]]
            return df.select(*[comp.column(n).alias(a) for n, a in (_alias(f) for f in fields)])
        if kind == "window":
            return _window(df, p, engine.properties)
        if kind == "groupby":
            df = df.select("*")
            df._tideql_groups = p["dimensions"]
            return df
        if kind == "aggfunc":
            node_, label = _alias(p["expr"])
            group = ([WINDOW] if WINDOW in df.columns else []) + list(keys)
            made = Compiler(_frame(df), {}, engine.properties, grouped=True)
            out = df.groupBy(*group).agg(made.column(node_).alias(label))
            return out.withColumn("window_end", F.unix_millis(f"{WINDOW}.end")) if WINDOW in df.columns else out
        if kind == "orderby":
            return df.orderBy(*[(F.col(s["field"]).desc_nulls_last() if s.get("order", "asc").lower() == "desc" else F.col(s["field"]).asc_nulls_last()) for s in p["sorts"]])
        if kind == "join":
            names = [a for a, _ in before[name]]
            parts = dict(zip(names, frames, strict=True))
            out = parts[p["from"]]
            out = Frame(out.select(*[F.col(c).alias(f"{p['from']}${c}") if not c.startswith("_") else F.col(c) for c in out.columns]), tuple((p["from"], c, f"{p['from']}${c}") for c in out.columns if not c.startswith("_")))
            for j in p["joins"]:
                other = parts[j["name"]]
                right = other.select(*[F.col(c).alias(f"{j['name']}${c}") for c in other.columns if not c.startswith("_")], *([F.col(WINDOW).alias("_rw")] if WINDOW in other.columns else []))
                columns = (*out.columns, *((j["name"], c, f"{j['name']}${c}") for c in other.columns if not c.startswith("_")))
                on = Compiler(Frame(out.df.join(right, F.lit(False), "left"), columns), {}, engine.properties).condition(parse_expr(j["on"]))
                if WINDOW in out.df.columns and "_rw" in right.columns:
                    on = on & (out.df[WINDOW] == right["_rw"])
                out = Frame(out.df.join(right, on, j.get("type", "inner").lower()).drop("_rw"), columns)
            seen, keep = set(), []
            for _, n, c in out.columns:
                if n not in seen:
                    seen.add(n)
                    keep.append(F.col(f"`{c}`").alias(n))
            return out.df.select(*keep, *[c for c in out.df.columns if c.startswith("_")])
        if kind == "switch":
            return sampling.switch(df, [comp.condition(parse_expr(c)) for c in p["cases"]], p.get("stopAtFirstMatch", False))
        if kind == "script":
            return df.mapInPandas(p["function"], p["schema"])
        raise PlanProblem(f"unknown operator {node['nodeType']!r}")

    last = [n for n in nodes if not edges.get(n)]
    out = value(graph.get("result", last[0]))
    out = out[0] if isinstance(out, list) else out
    return out.drop(*[c for c in out.columns if c.startswith("_")])
