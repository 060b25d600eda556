"""The function library: names to Column builders."""

from __future__ import annotations

from .registry import AGGREGATES, ANALYTIC, SCALARS, SETS, register_aggregate, register_function

__all__ = ["AGGREGATES", "ANALYTIC", "SCALARS", "SETS", "register_aggregate", "register_function"]
