"""A rule's SELECT as DataFrame calls, in the order that the dialect fixes.

Sources, analytic functions, window, joins, aggregates in WHERE, filter, grouping,
HAVING, row numbers, order, projection, rows from arrays.  Physical strategy is
Catalyst's: conditions stay bare so that they reach the scan, joins carry their
equalities, and no hint is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import AGGREGATES, ANALYTIC, SETS
from ..operators import hits, windows
from ..operators.analytic import BUCKET_MS, History
from ..sources.readers import placed
from ..sql import tree as t
from ..sql.parser import unit_ms
from .compiler import Compiler, conjuncts, is_aggregate
from .frame import TIME, WINDOW, Frame, PlanProblem

_ROW_STATE = ANALYTIC - {"row_number", "last_hit_count", "last_hit_time"}
_HITS = {"last_hit_count", "last_hit_time", "last_agg_hit_count", "last_agg_hit_time"}


class Planner:
    """``source(name)`` gives a (kind, DataFrame); a stream's event time is its column ``_ts``; ``_o``, its order of arrival, is added where a rule depends on it."""

    def __init__(self, source: Callable[[str], tuple[str, DataFrame]], properties: dict | None = None):
        self.source, self.properties, self.ordered = source, dict(properties or {}), True

    def plan(self, q: t.Select) -> DataFrame:
        q = self._check(q)
        calls = {n.name for n in q.walk() if isinstance(n, t.Call)}
        self.ordered = bool(calls & (ANALYTIC | _HITS | {"changed_cols", "deduplicate"})) or q.limit is not None or (q.window is not None and q.window.kind in ("count", "sliding", "state"))
        kind, df = self.source(q.source)
        frame = self._frame(df, q.alias, bool(q.joins))
        q, frame = self._analytic(q, frame)
        names = {f.alias.lower(): f.expr for f in q.items if f.alias}
        others: dict[str, Frame] = {}
        if q.window:
            if any(isinstance(n, t.Call) and n.name in _HITS for n in q.window.walk()):
                raise PlanProblem("hit functions stand in WHERE or HAVING")
            if (totals := self._sliding_totals(q, frame, names)) is not None:
                return totals
            frame, others = self._windows(q, frame, names)
        return self._finished(q, frame, names, others)

    def _finished(self, q: t.Select, frame: Frame, names: dict, others: dict[str, Frame]) -> DataFrame:
        """What follows a rule's windows."""
        for j in q.joins:
            frame = self._join(q, frame, j, others)
        make = lambda fr, **kw: Compiler(fr, names, self.properties, **kw)
        frame = self._filter(q, frame, make)
        grouped = bool(q.dims) or any(is_aggregate(f.expr) for f in q.items) or (q.having is not None and is_aggregate(q.having))
        return self._grouped(q, frame, make, names) if grouped else self._rows(q, frame, make, names)

    def streamed(self, q: t.Select) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None:
        """Of a rule that depends on earlier rows of a stream: the stream that keeps its state, and what is to be done with each micro-batch of it.

        None for other rules, which Spark can run over a stream as they are planned.
        """
        from ..streaming import rules

        if not rules.needed(q, _ROW_STATE | {"changed_cols"}):
            return None
        q = self._check(q)
        if any(isinstance(n, t.Call) and n.name in _HITS for n in q.walk()):
            raise PlanProblem("hit functions are for bounded rows")
        if any(self.source(j.source)[0] == "stream" for j in q.joins) or q.window is not None and q.window.kind not in rules.WINDOWS:
            raise PlanProblem("functions of earlier rows, and windows by count, state or row, are for one stream without time windows")
        frame = self._frame(self.source(q.source)[1], q.alias, bool(q.joins))
        names = {f.alias.lower(): f.expr for f in q.items if f.alias}
        calls = list(dict.fromkeys(n for n in q.walk() if isinstance(n, t.Call) and n.name in _ROW_STATE | {"changed_cols"}))
        if calls:
            q, frame = rules.earlier_rows(self, q, frame, calls, names)
            names = {f.alias.lower(): f.expr for f in q.items if f.alias}
        if q.window is not None:
            frame = rules.windowed(self, q, frame, names)
        return frame.df, lambda batch: self._finished(q, frame.with_df(batch), names, {})

    # --- checks

    def _check(self, q: t.Select) -> t.Select:
        sets = [c for f in q.items for c in f.expr.walk() if isinstance(c, t.Call) and c.name in SETS]
        if len(sets) > 1 or any(not (isinstance(f.expr, t.Call) and f.expr.name in SETS) for f in q.items for c in f.expr.walk() if isinstance(c, t.Call) and c.name in SETS):
            raise PlanProblem("one set-returning function, at the top of the SELECT list")
        for clause in (q.where, q.having, *q.dims):
            if clause is not None and any(isinstance(n, t.Call) and (n.name in SETS or n.name == "row_number") for n in clause.walk()):
                raise PlanProblem("set-returning functions and row_number() stand in the SELECT list only")
        for d in q.dims:
            if is_aggregate(d):
                raise PlanProblem("GROUP BY has no aggregates")
        aliased = {f.alias.lower(): f.expr for f in q.items if f.alias}
        if q.having is not None and not q.dims:
            parts = list(t.rewrite(q.having, lambda n: aliased.get(n.name.lower(), n) if isinstance(n, t.Name) and n.source is None else n).walk())
            if not any(isinstance(n, t.Call) and (n.name in AGGREGATES or n.name in _HITS) for n in parts):
                raise PlanProblem("HAVING needs aggregates")
        for f in q.items:
            self._cycle({x.alias.lower(): x.expr for x in q.items if x.alias}, f)
        return q

    def _cycle(self, names: dict[str, t.Node], f: t.Field) -> None:
        def visit(name: str, path: tuple[str, ...]):
            if name in path:
                raise PlanProblem(f"alias {name} stands in its own definition")
            for n in names[name].walk():
                if isinstance(n, t.Name) and n.source is None and (k := n.name.lower()) in names and k != name:
                    visit(k, (*path, name))

        if f.alias:
            visit(f.alias.lower(), ())

    def _frame(self, df: DataFrame, alias: str, joined: bool) -> Frame:
        df = placed(df) if self.ordered else df
        names = [c for c in df.columns if not c.startswith("_")]
        if not joined:
            return Frame(df, tuple((alias, c, c) for c in names))
        hidden = [c for c in df.columns if c.startswith("_")]
        df = df.select(*[F.col(f"`{c}`").alias(f"{alias}${c}") for c in names], *hidden)
        return Frame(df, tuple((alias, c, f"{alias}${c}") for c in names))

    # --- rows before windows

    def _analytic(self, q: t.Select, frame: Frame):
        calls = list(dict.fromkeys(n for n in q.walk() if isinstance(n, t.Call) and n.name in _ROW_STATE | {"changed_cols"}))
        if not calls:
            return q, frame
        names = {f.alias.lower(): f.expr for f in q.items if f.alias}
        if frame.time is None:
            raise PlanProblem("functions of earlier rows need a stream with a time")
        history, place = History(frame.df, [F.col(TIME), F.col("_o")], self.properties.get("bucket_ms", BUCKET_MS)), {}
        for c in calls:
            comp = Compiler(frame.with_df(history.df), names, self.properties)
            keys = [comp.column(k) for k in c.partition]
            when = None if c.when is None else comp.condition(c.when)
            if c.name == "changed_cols":
                continue
            place[c] = self._earlier(history, comp, c, keys, when)
        columns = list(frame.columns)
        items = []
        for f in q.items:
            if isinstance(f.expr, t.Call) and f.expr.name == "changed_cols":
                items += self._changed_cols(history, frame, names, f.expr, columns)
            else:
                items.append(f)
        history.flush()
        out = {}
        for c, col_name in place.items():
            columns.append(("", col_name, col_name))
            out[c] = t.Name(col_name)
        q = replace(q, items=tuple(items))
        q = t.rewrite(q, lambda n: out.get(n, n) if isinstance(n, t.Call) else n)
        return q, Frame(history.df.drop("_b"), tuple(columns))

    def _earlier(self, history: History, comp: Compiler, c: t.Call, keys, when) -> str:
        args = c.args
        value = lambda i, d=None: args[i].value if len(args) > i and isinstance(args[i], t.Lit) else d
        if c.name == "lag":
            default = comp.column(args[2]) if len(args) > 2 and value(2) is not None else None
            return history.lag(comp.column(args[0]), value(1, 1), default, value(3, True), keys, when)
        if c.name == "latest":
            return history.latest(comp.column(args[0]), comp.column(args[1]) if len(args) > 1 else None, keys, when)
        if c.name == "changed_col":
            hit, x = history.changed(comp.column(args[1]), value(0), keys, when)
            return history.then(lambda: F.when(F.col(hit), x))
        if c.name == "had_changed":
            each = [F.col(f"`{n}`") for _, _, n in comp.frame.columns if not n.startswith("_")] if isinstance(args[1], t.Star) else [comp.column(a) for a in args[1:]]
            found = [history.changed(x, value(0), keys, when)[0] for x in each]
            return history.then(lambda: reduce(lambda a, b: a | b, [F.col(n) for n in found]))
        x = F.lit(1) if isinstance(args[0], t.Star) else comp.column(args[0])
        begin, reset = (comp.condition(a) for a in args[1:3]) if len(args) == 3 else (None, None)
        return history.total(c.name.removeprefix("acc_"), x, begin, reset, keys, when)

    def _changed_cols(self, history: History, frame: Frame, names, c: t.Call, columns) -> list[t.Field]:
        prefix, skip = c.args[0].value, c.args[1].value
        comp = Compiler(frame.with_df(history.df), names, self.properties)
        each = [(n, F.col(f"`{col}`")) for _, n, col in frame.columns if not n.startswith("_")] if isinstance(c.args[2], t.Star) else [(a.name if isinstance(a, t.Name) else f"field_{i}", comp.column(a)) for i, a in enumerate(c.args[2:])]
        out = []
        for n, x in each:
            hit, value = history.changed(x, skip)
            name = history.then(lambda hit=hit, value=value: F.when(F.col(hit), value))
            columns.append(("", name, name))
            out.append(t.Field(t.Name(name), prefix + n))
        return out

    # --- windows and joins

    def _window(self, q: t.Select, frame: Frame, names, comp_frame: Frame | None = None) -> Frame:
        w, df = q.window, frame.df
        if frame.time is None:
            raise PlanProblem("a window needs a stream with a time")
        comp = Compiler(frame, names, self.properties)
        if w.where is not None:
            df = df.filter(comp.condition(w.where))
        n = [a.value for a in w.args if isinstance(a, t.Lit)]
        unit = unit_ms(w.unit) if w.unit else 1
        keys, order = [comp.column(k) for k in w.partition], [F.col(TIME), F.col("_o")]
        if w.kind == "tumbling":
            df = windows.tumbling(df, n[0] * unit)
        elif w.kind == "hopping":
            df = windows.hopping(df, n[0] * unit, n[1] * unit)
        elif w.kind == "session":
            df = windows.sessions(df, n[1] * unit, n[0] * unit)
        elif w.kind == "count":
            df = windows.counts(df, n[0], n[1] if len(n) > 1 else None, keys, order)
        elif w.kind == "sliding":
            df = windows.sliding(df, n[0] * unit, n[1] * unit if len(n) > 1 else 0, None if w.when is None else comp.condition(w.when), "_o")
        else:
            df = windows.states(df, comp.condition(w.args[0]), comp.condition(w.args[1]) if len(w.args) > 1 else None, keys, order)
        return frame.with_df(df)

    def _sliding_totals(self, q: t.Select, frame: Frame, names) -> DataFrame | None:
        """A rule that wants only totals of each sliding window, without a row for each of a window's rows; None for other rules."""
        w = q.window
        if w.kind != "sliding" or q.joins or q.dims or w.partition or q.limit is not None or frame.time is None or frame.df.isStreaming:
            return None
        rows = [n for c in (q.where, *(a for f in q.items for a in f.expr.walk() if isinstance(a, t.Call) and a.name in AGGREGATES)) if c is not None for n in c.walk() if isinstance(n, t.Call)]
        calls = list(dict.fromkeys(n for n in q.walk() if isinstance(n, t.Call) and n.name in AGGREGATES))
        kinds = {c.name.removeprefix("inc_") for c in calls}
        if not calls or not kinds <= {"count", "sum", "avg", "min", "max"} or (q.where is not None and is_aggregate(q.where)) or any(n not in calls and not n.args for n in rows):
            return None
        if any(isinstance(n, t.Call) and (n.name in SETS or n.name in ANALYTIC or n.name in _HITS) for n in q.walk()):
            return None
        put = {c: t.Name(f"_g{i}") for i, c in enumerate(calls)}
        late = lambda e: t.rewrite(e, lambda n: put.get(n, n) if isinstance(n, t.Call) else n)
        rest = [late(e) for e in (*(f.expr for f in q.items), *(s.key for s in q.order), *([] if q.having is None else [q.having]))]
        if any(isinstance(n, t.Star) or isinstance(n, t.Name) and n not in put.values() and (n.source is not None or n.name.lower() not in names) for e in rest for n in e.walk()):
            return None
        inner, totals, results = Compiler(frame, names, self.properties), {}, []
        for i, c in enumerate(calls):
            kind, star = c.name.removeprefix("inc_"), not c.args or isinstance(c.args[0], t.Star)
            if star and kind != "count":
                return None
            x = F.lit(1) if star else inner.column(c.args[0])
            type_ = inner.type_of(x)
            if kind in ("sum", "avg") and not isinstance(type_, (T.IntegralType, T.FloatType, T.DoubleType)):
                return None
            if c.where is not None:
                x = F.when(inner.condition(c.where), x)
            if c.name in ("inc_sum", "inc_avg"):
                x, type_ = x.cast("double"), T.DoubleType()
            if kind in ("count", "avg"):
                totals[f"_n{i}"] = ("sum", F.when(x.isNotNull(), 1).otherwise(0).cast("bigint"))
            if kind != "count":
                totals[f"_s{i}"] = ("sum" if kind == "avg" else kind, x.cast("double") if kind == "avg" and not isinstance(type_, T.IntegralType) else x)
            mean = F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}"))
            results.append({"count": F.col(f"_n{i}"), "avg": mean.cast("bigint") if isinstance(type_, T.IntegralType) else mean}.get(kind, F.col(f"_s{i}")).alias(f"_g{i}"))
        n, df = [a.value * unit_ms(w.unit) for a in w.args], frame.df
        if w.where is not None:
            df = df.filter(inner.condition(w.where))
        kept = None if q.where is None else inner.all(conjuncts(q.where))
        found = windows.sliding_totals(df, n[0], n[1] if len(n) > 1 else 0, None if w.when is None else inner.condition(w.when), kept, totals).select(WINDOW, *results)
        items = tuple(replace(f, expr=late(f.expr), alias=self._label(f, i)) for i, f in enumerate(q.items))
        q = replace(q, items=items, where=None, having=None if q.having is None else late(q.having), order=tuple(replace(s, key=late(s.key)) for s in q.order))
        known = {k: late(e) for k, e in names.items()}
        return self._rows(q, Frame(found, tuple(("", c.name, c.name) for c in put.values())), lambda fr, **kw: Compiler(fr, known, self.properties, **kw), known)

    def _windows(self, q: t.Select, frame: Frame, names) -> tuple[Frame, dict[str, Frame]]:
        """The first stream with its windows, and joined streams by alias with the same ones.

        Tumbling and hopping windows don't depend on rows, so each stream has them by itself.  The
        others do, on all rows of all streams: the streams are laid one upon another for them.
        """
        streams = [j for j in q.joins if self.source(j.source)[0] == "stream"]
        if not streams or q.window.kind in ("tumbling", "hopping"):
            return self._window(q, frame, names), {}
        frames = [frame, *[self._frame(self.source(j.source)[1], j.alias, True) for j in streams]]
        if any(f.time is None for f in frames):
            raise PlanProblem("a window needs streams with a time")
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df.withColumn("_n", F.lit(i)) for i, f in enumerate(frames)])
        whole = self._window(q, Frame(union, tuple(c for f in frames for c in f.columns)), names).df
        parts = [Frame(whole.filter(F.col("_n") == i).select(*[f"`{c}`" for c in f.df.columns], WINDOW), f.columns) for i, f in enumerate(frames)]
        return parts[0], {j.alias: f for j, f in zip(streams, parts[1:], strict=True)}

    def _join(self, q: t.Select, left: Frame, j: t.Join, others: dict[str, Frame]) -> Frame:
        kind, df = self.source(j.source)
        right = others.get(j.alias) or self._frame(df, j.alias, True)
        both_streams = kind == "stream" and q.window is not None
        if kind == "stream" and q.window is None:
            raise PlanProblem("streams are joined within a window")
        if both_streams and j.alias not in others:
            right = self._window(t.Select((), j.source, j.alias, window=t.Window(q.window.kind, q.window.unit, q.window.args)), right, {})
        hidden = {c: f"_r_{c}" for c in right.df.columns if c.startswith("_")}
        rdf = right.df.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in right.df.columns])
        columns = (*left.columns, *right.columns)
        on = F.lit(True)
        cross = left.df.join(rdf, F.lit(False), "left") if j.on is not None else None
        if j.on is not None:
            on = Compiler(Frame(cross, columns), {}, self.properties).condition(j.on)
        if both_streams:
            on = on & (left.df[WINDOW] == rdf[hidden[WINDOW]])
        df = left.df.crossJoin(rdf) if j.how == "cross" and not both_streams else left.df.join(rdf, on, "inner" if j.how == "cross" else j.how)
        for c in (TIME, WINDOW, "_o"):
            if c in hidden and c in left.df.columns:
                df = df.withColumn(c, F.coalesce(c, hidden[c])).drop(hidden[c])
        return Frame(df, columns)

    def _filter(self, q: t.Select, frame: Frame, make) -> Frame:
        if q.where is None:
            return frame
        names = {f.alias.lower(): f.expr for f in q.items if f.alias}
        full = lambda n: is_aggregate(n) or any(isinstance(x, t.Name) and x.source is None and x.name.lower() in names and is_aggregate(names[x.name.lower()]) for x in n.walk())
        state = lambda n: any(isinstance(x, t.Call) and x.name in ("last_hit_count", "last_hit_time") for x in n.walk())
        plain = [c for c in conjuncts(q.where) if not full(c) and not state(c)]
        whole = [c for c in conjuncts(q.where) if full(c)]
        late = [c for c in conjuncts(q.where) if state(c)]
        if whole:  # over the window's rows, before any of them goes
            calls = list(dict.fromkeys(n for c in whole for n in t.rewrite(c, lambda x: names.get(x.name.lower(), x) if isinstance(x, t.Name) and x.source is None else x).walk() if isinstance(n, t.Call) and n.name in AGGREGATES))
            if frame.window is None:
                raise PlanProblem("an aggregate in WHERE needs a window")
            comp = make(frame, grouped=True)
            values = frame.df.groupBy(WINDOW).agg(*[comp.column(c).alias(f"_g{i}") for i, c in enumerate(calls)])
            df = frame.df.join(values, WINDOW)
            put = {c: t.Name(f"_g{i}") for i, c in enumerate(calls)}
            frame = Frame(df, (*frame.columns, *(("", n.name, n.name) for n in put.values())))
            expand = lambda c: t.rewrite(t.rewrite(c, lambda x: names.get(x.name.lower(), x) if isinstance(x, t.Name) and x.source is None else x), lambda n: put.get(n, n) if isinstance(n, t.Call) else n)
            plain += [expand(c) for c in whole]
        if plain:
            frame = frame.with_df(frame.df.filter(make(frame).all(plain)))
        if late:
            # Only what the rule names goes through the one task; a * or a part of a structure may name anything.
            named = None if any(isinstance(n, (t.Star, t.Part)) for n in q.walk()) else {n.name.lower() for n in q.walk() if isinstance(n, t.Name)}
            needed = None if named is None else {c for _, n, c in frame.columns if n.lower() in named or n.startswith("_")}
            frame = hits.filtered(frame, late, make, needed)
        return frame

    # --- results

    def _label(self, f: t.Field, i: int) -> str:
        if f.alias:
            return f.alias
        if isinstance(f.expr, (t.Name, t.Part)):
            return f.expr.name
        return f.expr.name if isinstance(f.expr, t.Call) else f"field_{i}"

    def _star(self, star: t.Star, comp: Compiler, items) -> list[tuple[str, Column]]:
        replaced = {f.alias.lower(): f for f in star.replace}
        dropped = {n.lower() for n in star.drop}
        out, seen = [], set()
        for s, n, c in comp.frame.columns:
            if n.startswith("_") or n.lower() in seen or (star.source and s.lower() != star.source.lower()):
                continue
            if n.lower() in replaced:
                out.append((n, comp.named(names={}).column(replaced[n.lower()].expr)))
            elif n.lower() not in dropped:
                out.append((n, comp._first(F.col(f"`{c}`"))))
            seen.add(n.lower())
        return out

    def _columns(self, q: t.Select, comp: Compiler) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for i, f in enumerate(q.items):
            if f.invisible or isinstance(f.expr, t.Call) and f.expr.name == "row_number":
                continue
            if isinstance(f.expr, t.Star):
                taken = {(x.alias or "").lower() for x in q.items if x.alias}
                out += [(n, c) for n, c in self._star(f.expr, comp, q.items) if n.lower() not in taken]
            else:
                out.append((self._label(f, i), comp.column(f.expr)))
        return out

    def _finish(self, q: t.Select, df: DataFrame, keys: list[str], order: list[Column], names: list[str]) -> DataFrame:
        """Order, limit and projection; a limit holds for each window."""
        if q.limit is not None and keys:
            line = Window.partitionBy(*keys).orderBy(*(order or [F.col("_o")] if "_o" in df.columns else order or [F.lit(0)]))
            df = df.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= q.limit)
        if order:
            df = df.orderBy(*keys, *order)
        if q.limit is not None and not keys:
            df = df.limit(q.limit)
        sets = [f for f in q.items if isinstance(f.expr, t.Call) and f.expr.name in SETS]
        if not sets:
            return df.select(*[f"`{n}`" for n in names])
        label = self._label(sets[0], q.items.index(sets[0]))
        kind = dict((f.name, f.dataType) for f in df.schema)[label]
        if sets[0].expr.name == "extract":
            df, kind = df.withColumn(label, F.array(F.col(f"`{label}`"))), T.ArrayType(kind)
        if not isinstance(kind, T.ArrayType):
            raise PlanProblem(f"{sets[0].expr.name}() needs an array")
        df = df.withColumn(label, F.explode(f"`{label}`"))
        if isinstance(kind.elementType, T.StructType):  # its parts become columns and win over others
            parts = kind.elementType.names
            return df.select(*[f"`{n}`" for n in names if n != label and n not in parts], *[F.col(f"`{label}`")[p].alias(p) for p in parts])
        return df.select(*[f"`{n}`" for n in names])

    def _sorts(self, q: t.Select, comp: Compiler, columns: list[tuple[str, Column]]) -> list[tuple[Column, bool]]:
        known = {n.lower(): c for n, c in columns}
        return [(known[s.key.name.lower()] if isinstance(s.key, t.Name) and s.key.source is None and s.key.name.lower() in known else comp.column(s.key), s.ascending) for s in q.order]

    def _numbers(self, q: t.Select, comp: Compiler, window: list[Column]) -> list[tuple[str, Column, list]]:
        out = []
        for i, f in enumerate(q.items):
            if isinstance(f.expr, t.Call) and f.expr.name == "row_number":
                out.append((self._label(f, i), [comp.column(k) for k in f.expr.partition], [(comp.column(s.key), s.ascending) for s in f.expr.order]))
        return out

    def _emit(self, q, df, base, columns, sorts, numbers, keys, order_names):
        """Project, then number, order and limit by helper columns."""
        extra, order = [], []
        for i, (c, up) in enumerate(sorts):
            extra.append(c.alias(f"_k{i}"))
            order.append(F.col(f"_k{i}").asc_nulls_last() if up else F.col(f"_k{i}").desc_nulls_last())
        spans = []
        for i, (label, parts, sort) in enumerate(numbers):
            extra += [p.alias(f"_p{i}_{k}") for k, p in enumerate(parts)] + [c.alias(f"_q{i}_{k}") for k, (c, _) in enumerate(sort)]
            by = [F.col(f"_p{i}_{k}") for k in range(len(parts))]
            lines = [F.col(f"_q{i}_{k}").asc_nulls_last() if up else F.col(f"_q{i}_{k}").desc_nulls_last() for k, (_, up) in enumerate(sort)]
            spans.append((label, by, lines))
        out = base(df, columns, extra)
        for label, by, lines in spans:
            line = Window.partitionBy(*keys, *by) if keys or by else Window.partitionBy(F.lit(0))
            number = F.row_number().over(line.orderBy(*(lines or [F.col(c) for c in order_names]))) if keys or by or lines else F.lit(1)
            out = out.withColumn(label, number.cast("bigint"))
        names = [n for n, _ in columns]
        for i, f in enumerate(q.items):
            if isinstance(f.expr, t.Call) and f.expr.name == "row_number" and not f.invisible:
                names.insert(min(i, len(names)), self._label(f, i))
        return self._finish(q, out, keys, order, names)

    def _rows(self, q: t.Select, frame: Frame, make, names) -> DataFrame:
        comp = make(frame)
        sets = {i: f for i, f in enumerate(q.items) if isinstance(f.expr, t.Call) and f.expr.name in SETS}
        items = tuple(t.Field(f.expr.args[0], self._label(f, i)) if i in sets else f for i, f in enumerate(q.items))
        columns = self._columns(replace(q, items=items), comp)
        keys = [WINDOW] if frame.window is not None else []
        hidden = [c for c in (WINDOW, TIME, "_o") if c in frame.df.columns]
        base = lambda df, cols, extra: df.select(*[c.alias(n) for n, c in cols], *extra, *hidden)
        if q.having is not None:
            frame = frame.with_df(frame.df.filter(comp.condition(q.having)))
        return self._emit(q, frame.df, base, columns, self._sorts(q, comp, columns), self._numbers(q, comp, keys), keys, [c for c in (TIME, "_o") if c in hidden])

    def _grouped(self, q: t.Select, frame: Frame, make, names) -> DataFrame:
        plain = make(frame)
        keys = {d: plain.column(d) for d in q.dims}
        df = frame.df
        dims: dict[t.Node, Column] = {}
        group = []
        window = frame.window is not None
        if window:
            group.append(F.col(WINDOW))
        for i, (d, c) in enumerate(keys.items()):
            df = df.withColumn(f"_d{i}", c)
            group.append(F.col(f"_d{i}"))
            dims[d] = F.col(f"_d{i}")
        comp = make(frame.with_df(df), grouped=True, dims=dims)
        sets = {i: f for i, f in enumerate(q.items) if isinstance(f.expr, t.Call) and f.expr.name in SETS}
        items = tuple(t.Field(f.expr.args[0], self._label(f, i)) if i in sets else f for i, f in enumerate(q.items))
        hit = any(isinstance(n, t.Call) and n.name in _HITS for n in q.walk())
        if hit:
            return hits.grouped(self, replace(q, items=items), frame.with_df(df), make, group, dims, names)
        columns = self._columns(replace(q, items=items), comp)
        having = [] if q.having is None else [comp.condition(q.having).alias("_having")]

        def base(df, cols, extra):
            # The names of results come last: here they might be taken for columns that aggregates read.
            values = [*[c.alias(f"_v{i}") for i, (_, c) in enumerate(cols)], *extra, *having]
            out = df.groupBy(*group).agg(*values) if group else df.agg(*values)
            out = out.filter("_having") if having else out
            rest = [c for c in out.columns if not c.startswith("_v") and not c.startswith("_d")]
            return out.select(*[F.col(f"_v{i}").alias(n) for i, (n, _) in enumerate(cols)], *rest)

        return self._emit(q, df, base, columns, self._sorts(q, comp, columns), self._numbers(q, comp, []), [WINDOW] if window else [], [])
