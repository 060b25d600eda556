"""Syntax trees of rules and of stream definitions."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Node:
    def children(self):
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value):
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _nodes(v)


def rewrite(node: Any, change) -> Any:
    """The tree with ``change`` applied to every node, leaves first; what it returns takes the node's place."""
    if isinstance(node, (list, tuple)):
        return tuple(rewrite(v, change) for v in node)
    if not (isinstance(node, Node) and is_dataclass(node)):
        return node
    new = {f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}
    return change(type(node)(**new))


@dataclass(frozen=True)
class Lit(Node):
    value: Any


@dataclass(frozen=True)
class Name(Node):
    name: str
    source: str | None = None


@dataclass(frozen=True)
class Star(Node):
    source: str | None = None
    drop: tuple[str, ...] = ()
    replace: tuple = ()


@dataclass(frozen=True)
class Op(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


@dataclass(frozen=True)
class Member(Node):
    item: Node
    among: Any  # a tuple of nodes, or an array expression
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    item: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class Like(Node):
    item: Node
    pattern: Node
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    base: Node | None
    whens: tuple
    default: Node | None


@dataclass(frozen=True)
class Part(Node):
    """``a->b`` or ``a.b`` into a struct or map."""

    item: Node
    name: str


@dataclass(frozen=True)
class At(Node):
    item: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    item: Node
    start: Node | None
    stop: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple = ()
    partition: tuple = ()
    order: tuple = ()
    when: Node | None = None
    where: Node | None = None
    over: bool = False


@dataclass(frozen=True)
class Sort(Node):
    key: Node
    ascending: bool = True


@dataclass(frozen=True)
class Field(Node):
    expr: Node
    alias: str | None = None
    invisible: bool = False


@dataclass(frozen=True)
class Window(Node):
    kind: str
    unit: str | None = None
    args: tuple = ()
    where: Node | None = None
    when: Node | None = None
    partition: tuple = ()


@dataclass(frozen=True)
class Join(Node):
    how: str
    source: str
    alias: str
    on: Node | None


@dataclass(frozen=True)
class Select(Node):
    items: tuple
    source: str
    alias: str
    joins: tuple = ()
    where: Node | None = None
    window: Window | None = None
    dims: tuple = ()
    having: Node | None = None
    order: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class Definition(Node):
    """CREATE STREAM or CREATE TABLE."""

    kind: str
    name: str
    columns: tuple  # of (name, Spark type as text, default)
    options: dict = field(default_factory=dict)
    text: str = ""


@dataclass(frozen=True)
class Manage(Node):
    """SHOW, DESCRIBE, EXPLAIN or DROP."""

    action: str
    kind: str
    name: str | None = None
