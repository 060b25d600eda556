"""Definitions, formats, sinks, rules' life."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tideql.engine import Engine
from tideql.functions import register_aggregate, register_function
from tideql.plans.frame import PlanProblem
from tideql.sources import readers, sinks
from tideql.sql.parser import parse


@pytest.fixture()
def engine(spark):
    return Engine(spark, {"rule_id": "r"})


def stream(engine, name, columns, **options):
    text = ", ".join(f'{k}="{v}"' for k, v in options.items())
    engine.sql(f"CREATE STREAM {name} ({columns}) WITH ({text})")


def test_file_formats(engine, spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    (tmp_path / "d.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "c.csv").write_text("1;x\n2;y\n")
    (tmp_path / "u.txt").write_text("a=1&b=x%20y\na=zz\n")
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    at = lambda n: str(tmp_path / n)
    stream(engine, "j", "a BIGINT, b STRING", DATASOURCE=at("a.json"), FORMAT="json")
    stream(engine, "d", "", DATASOURCE=at("d.json"), FORMAT="jsondocument")
    stream(engine, "c", "a BIGINT, b STRING", DATASOURCE=at("c.csv"), FORMAT="delimited", DELIMITER=";")
    stream(engine, "u", "a BIGINT, b STRING", DATASOURCE=at("u.txt"), FORMAT="urlencoded")
    stream(engine, "l", "", DATASOURCE=at("l.txt"), FORMAT="lines")
    stream(engine, "b", "", DATASOURCE=at("b.bin"), FORMAT="binary")
    stream(engine, "p", "", DATASOURCE=at("p"), FORMAT="parquet")
    rows = lambda q: sorted((tuple(r) for r in engine.sql(q).collect()), key=repr)
    assert rows("SELECT * FROM j") == [(1, "x"), (2, None)]
    assert rows("SELECT a FROM d") == [(1,), (2,)]
    assert rows("SELECT a, b FROM c") == [(1, "x"), (2, "y")]
    assert rows("SELECT a, b FROM u") == [(1, "x y"), (None, None)]
    assert rows("SELECT line FROM l") == [("one",), ("two",)]
    assert rows("SELECT length(cast(self, 'string')) AS n FROM b") == [(2,)]
    assert rows("SELECT id FROM p") == [(0,), (1,), (2,)]


def test_strict_validation(engine, tmp_path):
    (tmp_path / "a.json").write_text('{"a": "1"}\n{"a": "x", "b": 1}\n{"b": 2}\n')
    stream(engine, "raw", "a STRING, b BIGINT", DATASOURCE=str(tmp_path / "a.json"), FORMAT="json")
    df = readers.validated(engine.source("raw")[1], parse('CREATE STREAM s (a BIGINT DEFAULT 7, b BIGINT) WITH (STRICT_VALIDATION="true")'))
    assert sorted(tuple(r) for r in df.collect()) == [(1, None), (7, 2)]


def test_definitions(engine, tmp_path):
    stream(engine, "s", "a BIGINT, p STRUCT(x FLOAT), l ARRAY(STRING)", DATASOURCE=str(tmp_path / "no"), FORMAT="json")
    engine.sql(f'CREATE TABLE t (a BIGINT) WITH (DATASOURCE="{tmp_path}/t.json", FORMAT="json", RETAIN_SIZE="2")')
    assert [r.result for r in engine.sql("SHOW STREAMS").collect()] == ["s"]
    assert [r.result for r in engine.sql("SHOW TABLES").collect()] == ["t"]
    with pytest.raises(PlanProblem):
        stream(engine, "s", "", DATASOURCE="x")
    (tmp_path / "t.json").write_text('{"a": 1}\n')
    assert [r.result for r in engine.sql("DESCRIBE TABLE t").collect()] == ["a bigint"]
    assert engine.sql("EXPLAIN TABLE t").count() > 3
    other = Engine(engine.spark)
    other.load(engine.export())
    assert sorted(other.definitions) == ["s", "t"]
    engine.sql("DROP STREAM s")
    assert engine.sql("SHOW STREAMS").count() == 0


def test_payload_and_decompression(spark):
    df = spark.createDataFrame([(1, bytearray(gzip.compress(b'[{"x": 1}, {"x": 2}]')))], "id bigint, body binary")
    out = readers.decode(readers.decompress(df, "body", "gzip"), "body", "json", "array<struct<x:bigint>>")
    assert sorted((r.id, r.x) for r in out.collect()) == [(1, 1), (1, 2)]


def test_unknown_connectors_are_named(engine):
    stream(engine, "m", "a BIGINT", DATASOURCE="t", TYPE="mqtt")
    with pytest.raises(readers.SourceProblem, match="register_source"):
        engine.sql("SELECT a FROM m")
    readers.register_source("mqtt", lambda spark, d, streaming: spark.range(2).select(F.col("id").alias("a")))
    assert engine.sql("SELECT a FROM m").count() == 2
    del readers._CUSTOM["mqtt"]
    with pytest.raises(sinks.SinkProblem):
        sinks.write(engine.spark.range(1), "redis", {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None), (2, None, None)], "a bigint, b string, c string")
    sinks.write(df, "file", {"path": str(tmp_path / "j"), "fileType": "json", "fields": ["a", "b"]})
    assert sorted(spark.read.json(str(tmp_path / "j")).collect()) == [(1, "x"), (2, None)]
    sinks.write(df, "file", {"path": str(tmp_path / "c"), "fileType": "csv", "compression": "gzip", "rollingCount": 1})
    assert len(list((tmp_path / "c").glob("*.gz"))) >= 2
    sinks.write(df, "file", {"path": str(tmp_path / "l"), "fileType": "lines", "dataTemplate": "{{.a}}:{{json .}}"})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "l")).collect())[0] == '1:{"a":1,"b":"x"}'
    assert json.loads(sinks.encoded(df, {"sendNil": True}).first().value) == {"a": 1, "b": "x", "c": None}
    packed = sinks.encoded(df, {"compression": "gzip"}).first().value
    assert json.loads(gzip.decompress(bytes(packed))) == {"a": 1, "b": "x"}
    secret = sinks.encoded(df, {"encryptionKey": "0123456789abcdef"})
    assert secret.select(F.aes_decrypt("value", F.lit("0123456789abcdef")).cast("string")).first()[0] == '{"a":1,"b":"x"}'
    assert sinks.transformed(df, {"sendSingle": False}).first().rows[0].a == 1
    sinks.write(df, "nop")
    seen = []
    sinks.register_sink("own", lambda d, o: seen.append((d.count(), o["k"])))
    sinks.write(df, "own", {"k": 5})
    assert seen == [(2, 5)]


def test_database(engine, spark):
    url = "jdbc:derby:memory:tests;create=true"
    sinks.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id bigint, name string"), "sql", {"url": url, "table": "T"})
    engine.sql(f"CREATE TABLE t () WITH (DATASOURCE='{url}', TYPE='sql', EXTRA='{{\"table\": \"T\"}}')")
    engine.sql(f"CREATE TABLE new () WITH (DATASOURCE='{url}', TYPE='sql', EXTRA='{{\"table\": \"T\", \"index\": \"id\", \"after\": 1}}')")
    assert sorted(tuple(r) for r in engine.sql("SELECT id, name FROM t WHERE id < 3").collect()) == [(1, "a"), (2, "b")]
    assert engine.sql("SELECT id FROM new").count() == 2


def test_shared_source(engine, spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"a": i}) for i in range(10)))
    stream(engine, "shared", "a BIGINT", DATASOURCE=str(tmp_path / "in"), FORMAT="json")
    for i in (3, 7):
        engine.create_rule({"id": f"m{i}", "sql": f"SELECT a FROM shared WHERE a >= {i}", "actions": [{"file": {"path": str(tmp_path / f"out{i}"), "fileType": "parquet"}}]})
    engine.create_rule({"id": "state", "sql": "SELECT count(*) AS n FROM shared"})
    with pytest.raises(PlanProblem):
        engine.start_shared("shared", ["m3", "state"], str(tmp_path / "c"))
    engine.start_shared("shared", ["m3", "m7"], str(tmp_path / "c")).awaitTermination(60)
    assert [spark.read.parquet(str(tmp_path / f"out{i}")).count() for i in (3, 7)] == [7, 3]
    engine.reset_state("m3")
    assert not (tmp_path / "c").exists()


def test_http(engine, spark):
    """A rule reads one address and posts to another."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self._answer(b'[{"a": 1}, {"a": 2}]' if self.path == "/list" else b'{"a": 3}')

        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self._answer(b"{}")

        def _answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    stream(engine, "web", "a BIGINT", DATASOURCE=f"{at}/list,{at}/one", TYPE="httppull")
    engine.create_rule({"id": "h", "sql": "SELECT a * 10 AS b FROM web", "actions": [{"rest": {"url": f"{at}/in"}}]})
    engine.run("h")
    assert sorted(x["b"] for x in got) == [10, 20, 30]
    got.clear()
    sinks.write(spark.range(5).repartition(1), "rest", {"url": f"{at}/in", "batchSize": 2})
    assert sorted(len(x) for x in got) == [1, 2, 2]
    server.shutdown()


def test_rule_life(engine, spark, tmp_path):
    engine.register("s", spark.createDataFrame([(1, 10), (2, 20)], "a bigint, ts bigint"), "ts")
    with pytest.raises(PlanProblem):
        engine.create_rule({"id": "bad", "sql": "SELECT nothing FROM s"})
    engine.create_rule(json.dumps({"id": "r1", "sql": "SELECT a * 2 AS b, rule_id() AS r FROM s", "actions": [{"memory": {"topic": "t/1"}}, {"nop": {}}]}))
    engine.run("r1")
    assert sorted(tuple(r) for r in readers.memory(spark, "t/#").collect()) == [(2, "r1"), (4, "r1")]
    assert engine.state("r1")["status"] == "stopped"
    assert "Scan" in engine.explain("SELECT a FROM s")
    assert engine.validate("SELECT a FROM s") is None and "unknown" in engine.validate("SELECT x FROM s")
    assert engine.trial("SELECT a + 1 AS b FROM m", {"m": ([{"a": 1}], "a bigint", None)}) == [{"b": 2}]
    assert json.loads(engine.export())["rules"][0]["id"] == "r1"
    engine.drop_rule("r1")


def test_user_functions(engine, spark):
    engine.register("s", spark.createDataFrame([(1, "x"), (2, "y")], "a bigint, b string"))
    register_function("twice", lambda c: c * 2)
    register_function("shout", lambda s: s.upper() + "!", returns="string")
    register_function("plus", lambda a: a + 1, returns="bigint")
    register_aggregate("spread", lambda c: F.max(c) - F.min(c))
    assert [tuple(r) for r in engine.sql("SELECT twice(a) AS t, shout(b) AS u, plus(a) AS p FROM s ORDER BY t").collect()] == [(2, "X!", 2), (4, "Y!", 3)]
    assert engine.sql("SELECT spread(a) AS d FROM s").first().d == 1
    from tideql.functions import AGGREGATES, SCALARS

    for n in ("twice", "shout", "plus"):
        del SCALARS[n]
    del AGGREGATES["spread"]


def test_filters_reach_the_scan(engine, spark):
    engine.register("e", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "ts")
    plan = engine.explain("SELECT event_id FROM e WHERE value > 50 AND event_type = 'click'")
    assert "GreaterThan(value,50" in plan and "EqualTo(event_type,click)" in plan
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
