"""Down-sampling of a source, and routing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.readers import placed

TIME = "_ts"


def _row_and_place(df: DataFrame, time: str) -> tuple[DataFrame, Column, Column]:
    """Rows, one as a struct, and what is largest for the last; of rows of one time it is the first that arrived."""
    columns = df.columns
    df = placed(df) if time == TIME else df
    first = [-F.col("_o")] if "_o" in df.columns else []
    return df, F.struct(*columns), F.struct(F.col(time), *first)


def latest(df: DataFrame, ms: int, time: str = TIME) -> DataFrame:
    """The last row of each interval, with the interval's end."""
    df, row, place = _row_and_place(df, time)
    out = df.groupBy(F.window(time, f"{ms} milliseconds").alias("w")).agg(F.max_by(row, place).alias("r"))
    return out.select(F.unix_millis("w.end").alias("interval_end"), "r.*")


def merged(df: DataFrame, ms: int, by: str, time: str = TIME) -> DataFrame:
    """The last row of each value of ``by`` in each interval, as the array ``frames`` in order of the value."""
    df, row, place = _row_and_place(df, time)
    last = df.groupBy(F.window(time, f"{ms} milliseconds").alias("w"), F.col(by).alias("k")).agg(F.max_by(row, place).alias("r"))
    out = last.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("f"))
    return out.select(F.unix_millis("w.end").alias("interval_end"), F.transform("f", lambda e: e["r"]).alias("frames"))


def switch(df: DataFrame, cases: list[Column], first_only: bool = False) -> list[DataFrame]:
    """A DataFrame for each case; with ``first_only`` a row goes to its first case alone."""
    out, taken = [], F.lit(False)
    for c in cases:
        hit = F.coalesce(c, F.lit(False))
        out.append(df.filter(hit & ~taken if first_only else hit))
        taken = taken | hit
    return out
