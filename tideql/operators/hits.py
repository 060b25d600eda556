"""last_hit_* and last_agg_hit_*: values of a clause's earlier passes, read while it is evaluated.

Whether a row passes depends on the rows that passed before it, so the clause is
run in order, as a fold over the few values it needs; all else stays in the plan.
The rows are sorted in ranges, by many tasks, and packed: a compressed block for each batch
of rows.  Only the blocks are put in order by the one task of the fold, which unpacks one
at a time and keeps a count and a time.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.frame import PlanProblem
from ..sql import tree as t

#: Rows of a block.
BLOCK = 50_000
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _value(node: t.Node, row: dict, state: dict):
    """A clause on one row: arithmetic, comparison and logic; any part without state has been computed before."""
    if isinstance(node, t.Lit):
        return node.value
    if isinstance(node, t.Name):
        return row[node.name]
    if isinstance(node, t.Call):
        return state["n"] if node.name.endswith("count") else state["t"]
    if isinstance(node, t.Op):
        a = _value(node.left, row, state)
        if node.op == "and":
            return bool(a) and bool(_value(node.right, row, state))
        if node.op == "or":
            return bool(a) or bool(_value(node.right, row, state))
        b = _value(node.right, row, state)
        if a is None or b is None or a != a or b != b:
            return False if node.op in ("=", "!=", "<", "<=", ">", ">=") else None
        return _COMPARE[node.op](a, b)
    raise PlanProblem("hit functions stand in comparisons, arithmetic, AND and OR")


def fold(df: DataFrame, clause: t.Node, order: list[str], parts: list[str]) -> DataFrame:
    """The rows that pass the clause, in order, with the state that each saw: ``_hits`` and ``_hit_time``."""

    def run(batches):
        state = {"n": 0, "t": 0}
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_t", *parts)]
            keep, seen = [], []
            for time, *row in zip(*values, strict=True):
                ok = bool(_value(clause, dict(zip(parts, row, strict=True)), state))
                keep.append(ok)
                if ok:
                    seen.append((state["n"], state["t"]))
                    state = {"n": state["n"] + 1, "t": time}
            kept = batch.filter(pa.array(keep, pa.bool_()))
            more = [pa.array([s[i] for s in seen], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], [*kept.schema.names, "_hits", "_hit_time"])

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some, sink = batch.slice(at, BLOCK), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                    out.write_batch(some)
                first = [some.column(some.schema.get_field_index(c)).slice(0, 1) for c in order]
                yield pa.RecordBatch.from_arrays([*first, pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*order, "_block"])

    def unpack(batches):
        for batch in batches:
            for block in batch.column(len(order)):
                yield from pa.ipc.open_stream(block.as_py())

    schema = T.StructType([*df.schema.fields, T.StructField("_hits", T.LongType()), T.StructField("_hit_time", T.LongType())])
    blocks = T.StructType([*[df.schema[c] for c in order], T.StructField("_block", T.BinaryType())])
    # Rows that are equal in their order are in one range, but may be in two blocks of it: these go by number.
    packed = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, blocks)
    packed = packed.withColumn("_part", F.monotonically_increasing_id())
    return packed.repartition(1).sortWithinPartitions(*order, "_part").drop("_part").mapInArrow(lambda b: run(unpack(b)), schema)


def _split(clause: t.Node, column: Callable[[t.Node], Any]):
    """The clause with every part that has no state replaced by a computed column."""
    parts: dict[str, Any] = {}

    def stateful(n: t.Node) -> bool:
        return any(isinstance(x, t.Call) and "hit_" in x.name for x in n.walk())

    def visit(n: t.Node) -> t.Node:
        if isinstance(n, t.Lit) or isinstance(n, t.Call) and "hit_" in n.name:
            return n
        if not stateful(n):
            name = f"_c{len(parts)}"
            parts[name] = column(n)
            return t.Name(name)
        if isinstance(n, t.Op):
            return t.Op(n.op, visit(n.left), visit(n.right))
        raise PlanProblem("hit functions stand in comparisons, arithmetic, AND and OR")

    return visit(clause), parts


def filtered(frame, clauses: list[t.Node], make, needed: set[str] | None = None):
    """The rows of a frame that pass clauses with last_hit_*; with ``needed`` only those columns go along."""
    clause = clauses[0]
    for c in clauses[1:]:
        clause = t.Op("and", clause, c)
    tree, parts = _split(clause, make(frame).column)
    rows = frame.df.withColumns({"_t": F.unix_millis("_ts"), **parts})
    if needed is not None:
        rows = rows.select(*[c for c in rows.columns if c in needed or c.startswith("_") or c in parts])
    return frame.with_df(fold(rows, tree, ["_t", "_o"], list(parts)).drop("_t", *parts))


def grouped(planner, q: t.Select, frame, make, group, dims, names):
    """Groups in order of their window's end, with last_agg_hit_* of HAVING."""
    comp = make(frame, grouped=True, dims=dims)
    hits = {"last_agg_hit_count": F.col("_hits"), "last_agg_hit_time": F.col("_hit_time")}
    shown = [(planner._label(f, i), f) for i, f in enumerate(q.items)]
    aliased = {f.alias.lower(): f.expr for f in q.items if f.alias}
    expand = lambda n: aliased.get(n.name.lower(), n) if isinstance(n, t.Name) and n.source is None else n
    tree, parts = _split(t.rewrite(q.having if q.having is not None else t.Lit(True), expand), comp.column)
    plain = [(n, comp.column(f.expr)) for n, f in shown if not (isinstance(f.expr, t.Call) and f.expr.name in hits)]
    out = frame.df.groupBy(*group).agg(*[c.alias(n) for n, c in plain], *[c.alias(n) for n, c in parts.items()])
    out = out.withColumns({"_t": F.unix_millis("_w.end"), "_key": F.xxhash64(*out.columns)}).drop("_w")
    passed = fold(out, tree, ["_t", "_key"], list(parts))
    return passed.select(*[(hits[f.expr.name] if isinstance(f.expr, t.Call) and f.expr.name in hits else F.col(f"`{n}`")).alias(n) for n, f in shown if not f.invisible])
