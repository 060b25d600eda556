"""A DataFrame with the names that a rule may use for its columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME, WINDOW = "_ts", "_w"


class PlanProblem(ValueError):
    """The rule can't be planned."""


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    columns: tuple[tuple[str, str, str], ...]  # (source, name, column)
    windowed: bool = False

    def find(self, name: str, source: str | None = None) -> str | None:
        """The column of a name; the leftmost source wins, and case matters only between equal names."""
        hits = [c for s, n, c in self.columns if n == name and (source is None or s.lower() == source.lower())]
        hits = hits or [c for s, n, c in self.columns if n.lower() == name.lower() and (source is None or s.lower() == source.lower())]
        return hits[0] if hits else None

    def has_source(self, name: str) -> bool:
        return any(s.lower() == name.lower() for s, _, _ in self.columns)

    def with_df(self, df: DataFrame, **more) -> Frame:
        return replace(self, df=df, **more)

    @property
    def time(self) -> Column | None:
        return F.col(TIME) if TIME in self.df.columns else None

    @property
    def window(self) -> Column | None:
        return F.col(WINDOW) if WINDOW in self.df.columns else None
