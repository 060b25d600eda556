"""One table for each class of function.

A scalar is built by ``f(call, *columns)``, an aggregate by ``f(call, *columns)`` too, where
``call`` tells types, literal values and the row's context (see ``Call``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Call:
    """What a builder may ask about a call."""

    name: str
    values: list  # literal values of arguments, else None
    type_of: Callable[[Column], T.DataType]
    time: Column | None = None  # the row's event time
    window: Column | None = None  # struct of start, end
    meta: Column | None = None
    properties: dict = field(default_factory=dict)
    place: Column | None = None  # the row's place among those of one time

    def is_text(self, c: Column) -> bool:
        return isinstance(self.type_of(c), T.StringType)

    def is_array(self, c: Column) -> bool:
        return isinstance(self.type_of(c), T.ArrayType)

    def is_map(self, c: Column) -> bool:
        return isinstance(self.type_of(c), T.MapType)

    def is_whole(self, c: Column) -> bool:
        return isinstance(self.type_of(c), T.IntegralType)


SCALARS: dict[str, Callable[..., Column]] = {}
AGGREGATES: dict[str, Callable[..., Column]] = {}
#: Names handled by the planner: values that depend on earlier rows, and functions that make rows.
ANALYTIC = {"lag", "latest", "changed_col", "had_changed", "acc_sum", "acc_count", "acc_avg", "acc_max", "acc_min", "last_hit_count", "last_hit_time", "row_number"}
SETS = {"unnest", "extract"}


def scalar(*names: str):
    def add(f):
        for n in names:
            SCALARS[n] = f
        return f

    return add


def aggregate(*names: str):
    def add(f):
        for n in names:
            AGGREGATES[n] = f
        return f

    return add


def register_function(name: str, f: Callable[..., Any], returns: str | None = None, vectorised: bool = False) -> None:
    """Add a user's scalar.

    Without ``returns``, ``f`` takes and gives Columns; with it, ``f`` is run in Python
    workers, on pandas Series if ``vectorised``.
    """
    if returns:
        udf = F.pandas_udf(f, returns) if vectorised else F.udf(f, returns, useArrow=True)
        SCALARS[name.lower()] = lambda call, *c: udf(*c)
    else:
        SCALARS[name.lower()] = lambda call, *c: f(*c)


def register_aggregate(name: str, f: Callable[..., Any], returns: str | None = None) -> None:
    """Add a user's aggregate: of Columns, or with ``returns`` of pandas Series to one value."""
    if returns:
        from pyspark.sql.pandas.functions import PandasUDFType

        udf = F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG)
        AGGREGATES[name.lower()] = lambda call, *c: udf(*c)
    else:
        AGGREGATES[name.lower()] = lambda call, *c: f(*c)


from . import aggregates, collections_, conversions, extras, math_, strings, times  # noqa: E402, F401
