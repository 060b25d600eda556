"""Headline rules at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each rule is run once to warm up and then three times into a sink that drops its rows; its figure is
the median.  ``rows_per_sec`` has the shapes that published figures exist for: one filter rule, and many
filter rules that share a source.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

NAMES = ["filter_cmp", "group_by_lineitem", "tumbling_count", "hopping", "sliding", "session_gap", "count_tumbling", "state_single", "join_inner", "join_windowed", "join_multi", "agg_median", "limit_per_window", "lag", "lag_partition_when", "acc_functions", "deduplicate_count", "fn_string", "fn_math", "graph_pipeline"]
RULES = 100


def shared_source(e, rules: int) -> float:
    """Seconds of ``rules`` rules, of which each keeps a tenth of the rows and drops them in its own sink, over a shared stream."""
    names = [f"r{i}" for i in range(rules)]
    for i, name in enumerate(names):
        e.create_rule({"id": name, "sql": f"SELECT l_orderkey, l_quantity FROM lines WHERE l_quantity > 45 AND l_extendedprice > {i}", "actions": [{"nop": {}}]})
    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        e.start_shared("lines", names, folder).awaitTermination()
        return time.perf_counter() - began


def main() -> None:
    from pyspark.sql import SparkSession

    from tideql import queries
    from tideql.engine import Engine
    from tideql.queries.base import engine

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(df_of) -> float:
        began = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took = {}
    for name in NAMES:
        run = lambda n=name: queries.QUERIES[n](spark, folder)
        once(run)
        took[name] = round(statistics.median(once(run) for _ in range(3)), 4)

    # One filter rule; and RULES of them, each planned, run and sunk by itself, over one read of a stream.
    e = engine(spark, folder)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    one = lambda: e.sql("SELECT * FROM lineitem WHERE l_quantity > 45")
    once(one)
    filter_s = statistics.median(once(one) for _ in range(3))
    lines = spark.readStream.schema(spark.read.parquet(f"{folder}/lineitem.parquet").schema).parquet(f"{folder}/lineitem.parquet*")
    shared_s = shared_source(Engine(spark).register("lines", lines), RULES)
    total = round(sum(took.values()), 4)
    figures = {"filter": round(rows / filter_s), f"shared_source_{RULES}_rules": round(rows * RULES / shared_s)}
    print(json.dumps({"metric": "sum of median seconds of headline rules", "value": total, "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf"), "rows_per_sec": figures, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
