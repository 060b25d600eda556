"""From a rule's text to a query that the driver can call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

#: Tables with a time are streams, the others are looked up.
STREAMS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
TABLES = ("region", "nation", "customer", "supplier", "part", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, **properties) -> Engine:
    """An engine over the tables of a folder; a table is opened when a rule names it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    e = Engine(spark, {"rule_id": "r1", "site": "north"} | properties)
    for name in (*STREAMS, *TABLES):
        e.attach(name, lambda n=name: spark.read.parquet(f"{sf_dir}/{n}.parquet"), STREAMS.get(name), "stream" if name in STREAMS else "table")
    return e


def rule(text: str, **properties) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir, **properties).sql(text)


def table(rows: list[tuple[str, str, str]]) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of (name, rule, SQL)."""
    names = [n for n, _, _ in rows]
    assert len(set(names)) == len(names), "a name stands twice"
    return {n: rule(r) for n, r, _ in rows}, {n: s for n, _, s in rows if s}
