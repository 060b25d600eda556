"""Stateful operators on unbounded streams."""

from .stateful import accumulate, count_window, dedup_spans, row_functions, sliding_window, state_window

__all__ = ["accumulate", "count_window", "dedup_spans", "row_functions", "sliding_window", "state_window"]
