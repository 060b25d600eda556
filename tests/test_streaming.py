"""Streaming forms against the batch forms, over several micro-batches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tideql import streaming
from tideql.engine import Engine

ROWS = [(i, i % 3, (i * 7) % 11 if i % 4 else None) for i in range(30)]
SCHEMA = "t bigint, k int, x bigint"


@pytest.fixture()
def source(spark, tmp_path):
    """The rows as six files, read a file at a time."""
    for part in range(6):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        file = folder / f"{part}.json"
        file.write_text("\n".join(json.dumps({"t": t, "k": k, "x": x}) for t, k, x in ROWS[part * 5 : part * 5 + 5]))
        os.utime(file, (1_000_000 + part, 1_000_000 + part))  # files are taken by age
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()]


def batch(spark, sql):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return Engine(spark).register("s", df, "t").sql(sql).collect()


def test_row_functions_equal_the_batch_form(spark, source, tmp_path):
    df = streaming.row_functions(source(), ["t"], {"l": ("lag", "x", 2), "n": ("latest", "x"), "c": ("changed", "x", True), "h": ("had_changed", ["x"], True)}, keys=["k"])
    want = batch(spark, "SELECT t, k, x, lag(x, 2) OVER (PARTITION BY k) AS l, latest(x) OVER (PARTITION BY k) AS n, changed_col(true, x) OVER (PARTITION BY k) AS c, had_changed(true, x) OVER (PARTITION BY k) AS h FROM s")
    assert sorted(run(spark, df, tmp_path, "rows")) == sorted(tuple(r) for r in want)


def test_accumulate_equals_the_batch_form(spark, source, tmp_path):
    df = streaming.accumulate(source(), ["t"], "x", ["count", "sum"], begin=lambda r: r["t"] % 5 == 1, reset=lambda r: r["t"] % 7 == 6)
    want = batch(spark, "SELECT t, k, x, acc_count(x, t % 5 = 1, t % 7 = 6) AS acc_count, acc_sum(x, t % 5 = 1, t % 7 = 6) AS acc_sum FROM s")
    assert sorted(run(spark, df, tmp_path, "acc")) == sorted(tuple(r) for r in want)


def test_windows_equal_the_batch_form(spark, source, tmp_path):
    out = {"n": "count", "m": "max"}
    got = run(spark, streaming.count_window(source(), ["t"], "t", out, 4, 2, keys=["k"]), tmp_path, "count")
    want = batch(spark, "SELECT k, count(*) AS n, max(t) AS m FROM s GROUP BY COUNTWINDOW(4, 2) OVER(PARTITION BY k)")
    assert sorted(got) == sorted(tuple(r) for r in want)
    got = run(spark, streaming.state_window(source(), ["t"], "t", out, lambda r: r["t"] % 6 == 2), tmp_path, "single")
    assert sorted(got) == sorted(tuple(r) for r in batch(spark, "SELECT count(*) AS n, max(t) AS m FROM s GROUP BY STATEWINDOW(t % 6 = 2)"))
    got = run(spark, streaming.state_window(source(), ["t"], "t", out, lambda r: r["t"] % 6 == 2, lambda r: r["t"] % 4 == 1), tmp_path, "both")
    assert sorted(got) == sorted(tuple(r) for r in batch(spark, "SELECT count(*) AS n, max(t) AS m FROM s GROUP BY STATEWINDOW(t % 6 = 2, t % 4 = 1)"))
    got = run(spark, streaming.sliding_window(source(), "t", "t", out, 3), tmp_path, "sliding")
    assert sorted(got) == sorted(tuple(r) for r in batch(spark, "SELECT count(*) AS n, max(t) AS m FROM s GROUP BY SLIDINGWINDOW(ms, 3)"))


def test_dedup_spans(spark, source, tmp_path):
    spans = source().select("t", (F.col("t") * 10 - F.col("k") * 15).alias("a"), (F.col("t") * 10 + 5).alias("b"))
    got = {r[0]: [tuple(p) for p in r[3]] for r in run(spark, streaming.dedup_spans(spans, "a", "b"), tmp_path, "spans")}
    seen, want = set(), {}
    for t, k, _ in ROWS:
        new = sorted(set(range(t * 10 - k * 15, t * 10 + 5)) - seen)
        seen |= set(new)
        parts = []
        for x in new:
            if parts and parts[-1][1] == x:
                parts[-1] = (parts[-1][0], x + 1)
            else:
                parts.append((x, x + 1))
        if parts:
            want[t] = parts
    assert got == want


def test_rule_runs_as_a_stream_and_resumes(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    e = Engine(spark)
    e.sql(f'CREATE STREAM s (t BIGINT, k BIGINT) WITH (DATASOURCE="{folder}", FORMAT="json", TYPE="file", TIMESTAMP="t")')
    folder.joinpath("a.json").write_text("\n".join(json.dumps({"t": t, "k": t % 2}) for t in range(0, 3000, 100)))
    e.create_rule({"id": "r", "sql": "SELECT k, count(*) AS n, window_end() AS e FROM s GROUP BY k, TUMBLINGWINDOW(ss, 1)", "actions": [{"file": {"path": str(out), "fileType": "parquet"}}], "options": {"lateTolerance": 0}})
    e.start("r", str(tmp_path / "c")).awaitTermination(120)
    folder.joinpath("b.json").write_text("\n".join(json.dumps({"t": t, "k": 0}) for t in (100, 2950, 9000)))
    e.start("r", str(tmp_path / "c")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(out)).select("k", "n", "e").collect())
    # The row at 100 is later than the watermark, and the window of 9000 is still open.
    assert got == [(0, 10, 1000), (0, 10, 2000), (0, 11, 3000)]
    assert e.state("r")["status"] == "stopped"


def rule(spark, tmp_path, source, name, sql, **more):
    """A rule's rows over the six files, one a micro-batch."""
    source()
    e = Engine(spark)
    e.register("s", source().withColumn("_ts", F.timestamp_millis("t")).withColumn("_o", F.col("t")))
    e.create_rule({"id": name, "actions": [{"file": {"path": str(tmp_path / name), "fileType": "parquet"}}], "sql": sql, **more})
    e.start(name, str(tmp_path / f"{name}-c")).awaitTermination(120)
    return sorted((tuple(r.asDict().items()) for r in spark.read.parquet(str(tmp_path / name)).collect()), key=str)


RULES = {
    "earlier": "SELECT t, lag(x) OVER (PARTITION BY k) AS l, latest(x, 0) OVER (PARTITION BY k) AS n, changed_col(true, x) AS c, had_changed(true, x, k) AS h FROM s",
    "when": "SELECT t, lag(x, 2, 7) OVER (PARTITION BY k WHEN x > 3) AS l, acc_sum(x) OVER (PARTITION BY k) AS a, acc_count(x, t % 5 = 1, t % 7 = 6) AS b FROM s WHERE t > 3",
    "counted": "SELECT count(*) AS n, max(x) AS m, sum(x) AS a, window_end() AS e FROM s GROUP BY COUNTWINDOW(4, 2)",
    "counted_keys": "SELECT k, count(*) AS n, max(t) AS m FROM s GROUP BY COUNTWINDOW(3) OVER(PARTITION BY k), k",
    "stated": "SELECT count(*) AS n, max(t) AS m FROM s GROUP BY STATEWINDOW(t % 6 = 2, t % 4 = 1)",
    "slid": "SELECT count(*) AS n, max(t) AS m, avg(x) AS a FROM s GROUP BY SLIDINGWINDOW(ms, 3) OVER(WHEN x > 2) HAVING count(*) > 1",
    "slid_rows": "SELECT t, x FROM s GROUP BY SLIDINGWINDOW(ms, 2)",
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_rules_over_earlier_rows_stream(spark, source, tmp_path, name):
    got = rule(spark, tmp_path, source, name, RULES[name])
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = Engine(spark).register("s", df, "t").sql(RULES[name]).collect()
    assert got == sorted((tuple(r.asDict().items()) for r in want), key=str)


def test_types_pass_through_the_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(6).selectExpr("id AS t", "timestamp_micros(id * 1000001) AS w", "cast(id / 4 AS decimal(9,3)) AS d", "named_struct('a', id, 'b', array(id)) AS s").write.parquet(str(tmp_path / "in/p"))
    df = spark.readStream.schema("t bigint, w timestamp, d decimal(9,3), s struct<a: bigint, b: array<bigint>>").parquet(str(tmp_path / "in/p"))
    e = Engine(spark)
    e.register("s", df.withColumn("_ts", F.timestamp_millis("t")).withColumn("_o", F.col("t")))
    for name, sql in {"a": "SELECT t, lag(w) AS w1, latest(d) AS d1, lag(s) AS s1 FROM s", "b": "SELECT t, w AS w1, d AS d1, s AS s1 FROM s GROUP BY COUNTWINDOW(3)"}.items():
        e.create_rule({"id": name, "sql": sql, "actions": [{"file": {"path": str(tmp_path / name), "fileType": "parquet"}}]})
        e.start(name, str(tmp_path / f"{name}-c")).awaitTermination(120)
        got = sorted(spark.read.parquet(str(tmp_path / name)).collect(), key=lambda r: r.t)
        rows = sorted(spark.read.parquet(str(tmp_path / "in/p")).collect(), key=lambda r: r.t)
        assert [r.d1 for r in got] == [r.d for r in rows]
        assert [r.w1 for r in got] == ([None, *(r.w for r in rows[:-1])] if name == "a" else [r.w for r in rows])
        assert [r.s1 for r in got] == ([None, *(r.s for r in rows[:-1])] if name == "a" else [r.s for r in rows])


def test_graph_rule_streams(spark, source, tmp_path):
    source()
    e = Engine(spark)
    e.sql(f'CREATE STREAM s (t BIGINT, k BIGINT, x BIGINT) WITH (DATASOURCE="{tmp_path}/in", FORMAT="json", TYPE="file", TIMESTAMP="t")')
    graph = {"nodes": {"s": {"type": "source", "nodeType": "file", "props": {"sourceName": "s"}}, "f": {"type": "operator", "nodeType": "filter", "props": {"expr": "x > 3"}}, "w": {"type": "operator", "nodeType": "watermark", "props": {}}, "p": {"type": "operator", "nodeType": "pick", "props": {"fields": ["t", "x"]}}}, "topo": {"sources": ["s"], "edges": {"s": ["w"], "w": ["f"], "f": ["p"]}}}
    e.create_rule({"id": "g", "graph": graph, "actions": [{"file": {"path": str(tmp_path / "o"), "fileType": "parquet"}}]})
    e.start("g", str(tmp_path / "c")).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == sorted((t, x) for t, _, x in ROWS if x is not None and x > 3)


def test_patrol_counts_attempts(spark, source, tmp_path):
    from tideql.sources import sinks

    def refuse(df, options):
        raise RuntimeError("no")

    sinks.register_sink("refuses", refuse)
    e = Engine(spark)
    e.register("s", source())
    for i, how in {"a": {"attempts": 2}, "b": {"attempts": 1}, "c": {"attempts": 1, "delay": 60_000}}.items():
        e.create_rule({"id": i, "sql": "SELECT t FROM s", "actions": [{"refuses": {}}], "options": {"restartStrategy": how}})
    ended = lambda i: pytest.raises(Exception, e.rules[i].query.awaitTermination, 60)
    e.start("a", str(tmp_path / "a"))
    ended("a")
    assert e.patrol() == ["a"] and e.rules["a"].attempts == 1
    ended("a")
    assert e.patrol() == ["a"]
    ended("a")
    assert e.patrol() == [] and e.patrol() == [] and e.rules["a"].status == "failed"
    e.start_shared("s", ["b", "c"], str(tmp_path / "b"))
    ended("b")
    assert sorted(e.patrol()) == ["b", "c"] and e.rules["b"].query is e.rules["c"].query


def test_schedules():
    from datetime import UTC, datetime

    from tideql import schedule

    at = lambda text: datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()
    assert schedule.seconds("1h30m") == 5400
    daily = {"cron": "30 8 * * 1-5", "duration": "10m"}  # Monday to Friday
    assert [schedule.due(daily, at(f"2024-01-{d}")) for d in ("05 08:30:00", "05 08:39:59", "05 08:40:00", "06 08:35:00")] == [True, True, False, False]
    assert schedule.due({"cron": "*/15 * * * *", "duration": "1m"}, at("2024-01-01 10:45:30"))
    spans = {"cronDatetimeRange": [{"begin": "2024-01-01 00:00:00", "end": "2024-01-02 00:00:00"}]}
    assert schedule.due(spans, at("2024-01-01 12:00:00")) and not schedule.due(spans, at("2024-01-03 00:00:00"))
