"""Expressions to Columns, with the dialect's treatment of null, division and places."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import AGGREGATES, SCALARS
from ..functions.collections_ import pick
from ..functions.registry import Call
from ..sql import tree as t
from .frame import Frame, PlanProblem


def is_aggregate(node: t.Node) -> bool:
    return any(isinstance(n, t.Call) and n.name in AGGREGATES for n in node.walk())


def conjuncts(node: t.Node | None) -> list[t.Node]:
    if node is None:
        return []
    if isinstance(node, t.Op) and node.op == "and":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


@dataclass
class Compiler:
    """``names`` are the SELECT list's aliases; in ``grouped`` mode columns outside of aggregates are a group's first."""

    frame: Frame
    names: dict[str, t.Node] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)
    grouped: bool = False
    dims: dict[t.Node, Column] = field(default_factory=dict)
    _open: tuple[str, ...] = ()

    def type_of(self, c: Column) -> T.DataType:
        return self.frame.df.select(c.alias("x")).schema[0].dataType

    def named(self, *changes, **kw) -> Compiler:
        return Compiler(**({"frame": self.frame, "names": self.names, "properties": self.properties, "grouped": self.grouped, "dims": self.dims, "_open": self._open} | kw))

    # --- conditions

    def condition(self, node: t.Node) -> Column:
        """For a filter: null counts as false by itself, so comparisons stay bare and can be pushed down."""
        if isinstance(node, t.Op) and node.op in ("and", "or"):
            a, b = self.condition(node.left), self.condition(node.right)
            return a & b if node.op == "and" else a | b
        if isinstance(node, t.Op) and node.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(node)
        return self.column(node)

    def compare(self, node: t.Op) -> Column:
        a, b = self.column(node.left), self.column(node.right)
        # A time stands beside milliseconds or a text.
        for lit, other in ((node.left, b), (node.right, a)):
            if isinstance(lit, t.Lit) and type(lit.value) is int and isinstance(self.type_of(other), (T.TimestampType, T.TimestampNTZType)):
                time = F.timestamp_millis(F.lit(lit.value))
                a, b = (time, b) if lit is node.left else (a, time)
                break
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op]

    # --- values

    def column(self, node: t.Node) -> Column:
        if node in self.dims:
            return self.dims[node]
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _lit(self, node: t.Lit) -> Column:
        return F.lit(node.value).cast("bigint") if type(node.value) is int else F.lit(node.value)

    def _first(self, c: Column) -> Column:
        if not self.grouped:
            return c
        time = self.frame.time
        return F.first(c) if time is None else F.min_by(c, time)

    def _name(self, node: t.Name) -> Column:
        key = node.name.lower()
        if node.source is None and key in self.names and key not in self._open:
            target = self.names[key]
            if not (isinstance(target, t.Name) and target.name.lower() == key):
                return self.named(_open=(*self._open, key)).column(target)
        found = self.frame.find(node.name, node.source)
        if found is not None:
            return self._first(F.col(f"`{found}`"))
        if node.source is not None and not self.frame.has_source(node.source):
            return self._part(t.Part(t.Name(node.source), node.name))
        if node.source is None and key in self._open:
            raise PlanProblem(f"alias {node.name} stands in its own definition")
        raise PlanProblem(f"unknown column {f'{node.source}.' if node.source else ''}{node.name}")

    def _op(self, node: t.Op) -> Column:
        op = node.op
        if op in ("and", "or"):
            a, b = self.column(node.left), self.column(node.right)
            return a & b if op == "and" else a | b
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return F.coalesce(self.compare(node), F.lit(False))
        a, b = self.column(node.left), self.column(node.right)
        if op == "/":
            if isinstance(self.type_of(a), T.IntegralType) and isinstance(self.type_of(b), T.IntegralType):
                zero = b == 0
                return F.when(~zero, F.call_function("div", a, b)) if self.properties.get("lenient", True) else F.call_function("div", a, b)
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "%":
            return F.try_mod(a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b), "^": lambda: a.bitwiseXOR(b)}[op]()

    def _not(self, node: t.Not) -> Column:
        return ~F.coalesce(self.column(node.inner), F.lit(False))

    def _member(self, node: t.Member) -> Column:
        item = self.column(node.item)
        if isinstance(node.among, tuple):
            some = [self.column(a) for a in node.among if not (isinstance(a, t.Lit) and a.value is None)]
            found = F.coalesce(item.isin(*some), F.lit(False)) if some else F.lit(False)
        else:
            found = F.coalesce(F.array_contains(self.column(node.among), item), F.lit(False))
        return item.isNotNull() & ~found if node.negated else found

    def _between(self, node: t.Between) -> Column:
        c = self.column(node.item).between(self.column(node.low), self.column(node.high))
        return F.coalesce(~c if node.negated else c, F.lit(False))

    def _like(self, node: t.Like) -> Column:
        c = self.column(node.item)
        hit = c.like(node.pattern.value) if isinstance(node.pattern, t.Lit) else F.like(c, self.column(node.pattern))
        return F.coalesce(~hit if node.negated else hit, F.lit(False))

    def _case(self, node: t.Case) -> Column:
        out = None
        base = None if node.base is None else self.column(node.base)
        for when, then in node.whens:
            test = self.condition(when) if base is None else base == self.column(when)
            out = F.when(test, self.column(then)) if out is None else out.when(test, self.column(then))
        return out if node.default is None else out.otherwise(self.column(node.default))

    def _part(self, node: t.Part) -> Column:
        item = self.column(node.item)
        if isinstance(self.type_of(item), T.StringType):
            return F.get_json_object(item, f"$.{node.name}")
        if isinstance(self.type_of(item), T.MapType):
            return F.try_element_at(item, F.lit(node.name))
        return item.getField(node.name)

    def _at(self, node: t.At) -> Column:
        return pick(self.column(node.item), self.column(node.index))

    def _slice(self, node: t.Slice) -> Column:
        a = self.column(node.item)
        place = lambda n, d: F.lit(d) if n is None else F.when((c := self.column(n).cast("int")) < 0, F.size(a) + c).otherwise(c)
        start = place(node.start, 0)
        stop = F.size(a) if node.stop is None else place(node.stop, 0)
        return F.slice(a, start + 1, F.greatest(F.lit(0), stop - start))

    def _call(self, node: t.Call) -> Column:
        call = Call(node.name, [a.value if isinstance(a, t.Lit) else None for a in node.args], self.type_of, self.frame.time, self.frame.window if not (self.grouped and "_window" in self.properties) else self.properties["_window"], F.col("_meta") if "_meta" in self.frame.df.columns else None, self.properties, F.col("_o") if "_o" in self.frame.df.columns else None)
        if node.name in AGGREGATES:
            if not self.grouped:
                raise PlanProblem(f"{node.name}() stands outside of an aggregation")
            return self.aggregate(node, call)
        if node.name not in SCALARS:
            raise PlanProblem(f"unknown function {node.name}()")
        if node.name == "meta" and isinstance(node.args[0], t.Name):
            return SCALARS["meta"](call, F.lit(node.args[0].name))
        if self.grouped and node.name == "event_time" and call.window is None:
            return F.unix_millis(F.max(self.frame.time))
        return SCALARS[node.name](call, *[self.column(a) for a in node.args])

    def row(self, source: str | None = None) -> Column:
        return F.struct(*[F.col(f"`{c}`").alias(n) for s, n, c in self.frame.columns if source is None or s.lower() == source.lower()])

    def aggregate(self, node: t.Call, call: Call) -> Column:
        inner = self.named(grouped=False, dims={})
        args = list(node.args)
        star = bool(args) and isinstance(args[0], t.Star)
        if node.name.endswith("count") and (star or not args):
            one = F.lit(1) if node.where is None else F.when(inner.condition(node.where), 1)
            return F.count(one)
        columns = [inner.row(a.source) if isinstance(a, t.Star) else inner.column(a) for a in args]
        if node.name == "deduplicate":
            columns = [inner.row(), *columns]
            call.values.insert(0, None)
        if node.where is not None:
            columns[0] = F.when(inner.condition(node.where), columns[0])
        return AGGREGATES[node.name](call, *columns)

    def all(self, nodes) -> Column:
        return reduce(lambda a, b: a & b, [self.condition(n) for n in nodes])
