"""Services over sockets and HTTP, against small ones made here."""

import json
import socketserver
import sqlite3
import struct
import threading
import time
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tideql.sources import services, sinks


@contextmanager
def serving(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield server.server_address[1]
    finally:
        server.shutdown()
        server.server_close()


class RedisServer(socketserver.ThreadingTCPServer):
    daemon_threads = allow_reuse_address = True

    def __init__(self):
        self.values, self.lists, self.published, self.asked = {}, {}, [], []
        super().__init__(("127.0.0.1", 0), RedisHandler)


class RedisHandler(socketserver.StreamRequestHandler):
    def handle(self):
        s, bulk = self.server, lambda x: b"$-1\r\n" if x is None else b"$%d\r\n%s\r\n" % (len(x), x)
        while line := self.rfile.readline():
            parts = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                parts.append(self.rfile.read(n + 2)[:-2])
            name, *a = parts
            s.asked.append(parts)
            out = b"+OK\r\n"
            if name == b"SET":
                s.values[a[0]] = a[1]
            elif name == b"GET":
                out = bulk(s.values.get(a[0]))
            elif name == b"DEL":
                out = b":%d\r\n" % (s.values.pop(a[0], None) is not None)
            elif name == b"LPUSH":
                s.lists.setdefault(a[0], []).insert(0, a[1])
                out = b":1\r\n"
            elif name == b"LRANGE":
                found = s.lists.get(a[0], [])
                out = b"*%d\r\n" % len(found) + b"".join(map(bulk, found))
            elif name == b"PUBLISH":
                s.published.append((a[0], a[1]))
                out = b":0\r\n"
            elif name == b"SUBSCRIBE":
                out = b"*3\r\n" + bulk(b"subscribe") + bulk(a[0]) + b":1\r\n"
                out += b"".join(b"*3\r\n" + bulk(b"message") + bulk(a[0]) + bulk(json.dumps({"x": i}).encode()) for i in range(3))
            elif name == b"AUTH" and a[0] != b"right":
                out = b"-WRONGPASS\r\n"
            self.wfile.write(out)


class MqttServer(socketserver.ThreadingTCPServer):
    daemon_threads = allow_reuse_address = True

    def __init__(self):
        self.got = []
        super().__init__(("127.0.0.1", 0), MqttHandler)


class MqttHandler(socketserver.StreamRequestHandler):
    """Accepts, notes what is published, and sends three messages to whoever subscribes."""

    def packet(self):
        head = self.rfile.read(1)
        if not head:
            return None
        n, shift = 0, 0
        while True:
            b = self.rfile.read(1)[0]
            n, shift = n | (b & 127) << shift, shift + 7
            if b < 128:
                return head[0], self.rfile.read(n)

    def handle(self):
        while p := self.packet():
            kind, body = p
            if kind >> 4 == 1:
                self.wfile.write(b"\x20\x02\x00\x00")
            elif kind >> 4 == 3:
                n = struct.unpack(">H", body[:2])[0]
                topic, rest = body[2 : 2 + n], body[2 + n :]
                if kind & 6:
                    self.wfile.write(b"\x40\x02" + rest[:2])
                    rest = rest[2:]
                self.server.got.append((topic.decode(), rest, bool(kind & 1)))
            elif kind >> 4 == 8:
                self.wfile.write(b"\x90\x03" + body[:2] + b"\x00")
                topic = b"\x00\x03a/b"
                for i in range(3):
                    raw = json.dumps({"x": i, "pad": "y" * 200}).encode()
                    size = len(topic) + len(raw)
                    self.wfile.write(b"\x30" + bytes([size & 127 | 128, size >> 7]) + topic + raw)
            elif kind >> 4 == 14:
                return


class Http(ThreadingHTTPServer):
    def __init__(self, answer=lambda path, body: b"{}"):
        self.got, self.answer = [], answer
        super().__init__(("127.0.0.1", 0), HttpHandler)


class HttpHandler(BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        self.server.got.append((self.path, body.decode(), dict(self.headers)))
        found = self.server.answer(self.path, body)
        self.send_response(404 if found is None else 200)
        self.end_headers()
        self.wfile.write(found or b"")

    do_GET = do_POST  # noqa: N815

    def log_message(self, *a):
        pass


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, "b c", None), (3, 'd"e', 2.0)], "k bigint, s string, v double").repartition(2)


def test_redis_sink_and_lookup(spark, rows):
    with serving(r := RedisServer()) as port:
        sinks.write(rows, "redis", {"addr": f"127.0.0.1:{port}", "field": "k"})
        assert {k: json.loads(v) for k, v in r.values.items()} == {b"1": {"k": 1, "s": "a", "v": 1.5}, b"2": {"k": 2, "s": "b c"}, b"3": {"k": 3, "s": 'd"e', "v": 2.0}}
        sinks.write(rows.selectExpr("k", "if(k = 2, 'delete', 'upsert') AS kind"), "redis", {"addr": f"redis://127.0.0.1:{port}", "field": "k", "rowkindField": "kind"})
        assert set(r.values) == {b"1", b"3"}
        sinks.write(rows.filter("k = 1").select("s"), "redis", {"addr": f"127.0.0.1:{port}", "keyType": "multiple", "dataType": "list"})
        assert r.lists == {b"s": [b"a"]}
        sinks.write(rows.filter("k = 1"), "redispub", {"address": f"127.0.0.1:{port}", "channel": "c"})
        assert r.published == [(b"c", b'{"k":1,"s":"a","v":1.5}')]
        r.values[b"1"] = b'[{"w": 1}, {"w": 2}]'
        probes = spark.createDataFrame([(1,), (1,), (9,), (None,)], "k bigint").coalesce(1)
        got = services.redis_lookup(probes, "k", "w int", {"addr": f"127.0.0.1:{port}", "cache": True, "cacheTtl": 60, "cacheMissingKey": True})
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1), (1, 2), (1, 1), (1, 2), (9, None), (None, None)], key=str)
        assert sum(p[0] == b"GET" for p in r.asked) == 2
        with pytest.raises(services.ServiceProblem):
            services.Redis(f"127.0.0.1:{port}", "wrong")


def test_mqtt_sink_and_source(spark, rows):
    with serving(m := MqttServer()) as port:
        for qos in (0, 1):
            sinks.write(rows.select("k"), "mqtt", {"server": f"tcp://127.0.0.1:{port}", "topic": "out", "qos": qos, "retained": True})
        time.sleep(0.3)
        assert sorted(m.got) == sorted([("out", b'{"k":%d}' % k, True) for k in (1, 2, 3)] * 2)
        from tideql.engine import Engine

        e = Engine(spark)
        e.sql(f"""CREATE STREAM s (x BIGINT) WITH (DATASOURCE="a/b", FORMAT="json", TYPE="mqtt", EXTRA="{{\\"server\\": \\"127.0.0.1:{port}\\", \\"seconds\\": \\"1\\"}}")""")
        assert sorted(r.x for r in e.sql("SELECT x FROM s WHERE x > 0").collect()) == [1, 2]


def test_redis_subscription_as_a_stream(spark, tmp_path):
    with serving(RedisServer()) as port:
        df = services.messages(spark, "redis", f"127.0.0.1:{port}", "ch", {"seconds": "0.5"}, True).selectExpr("topic", "cast(payload AS string) AS p")
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
        for _ in range(60):
            time.sleep(0.5)
            if q.lastProgress and (tmp_path / "o").exists() and any((tmp_path / "o").glob("*.parquet")):
                break
        q.stop()
        got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
        assert got == {("ch", json.dumps({"x": i})) for i in range(3)}


def test_influx_and_tdengine(rows):
    with serving(h := Http()) as port:
        sinks.write(rows.withColumn("ts", rows.k * 1000), "influx2", {"addr": f"http://127.0.0.1:{port}", "org": "o", "bucket": "b", "token": "t", "measurement": "m", "tags": {"tag": "{{.s}}"}, "fields": ["k", "v"], "tsFieldName": "ts"})
        lines = sorted(x for _, body, _ in h.got for x in body.split("\n"))
        assert lines == ["m,tag=a k=1i,v=1.5 1000", "m,tag=b\\ c k=2i 2000", 'm,tag=d"e k=3i,v=2.0 3000']
        assert h.got[0][0].startswith("/api/v2/write?org=o&bucket=b&precision=ms") and h.got[0][2]["Authorization"] == "Token t"
        h.got.clear()
        sinks.write(rows, "influx", {"addr": f"http://127.0.0.1:{port}", "database": "d", "measurement": "m", "fields": ["s"]})
        assert sorted(x for _, body, _ in h.got for x in body.split("\n")) == ['m s="a"', 'm s="b c"', 'm s="d\\"e"']
        h.got.clear()
        sinks.write(rows.filter("k < 3"), "tdengine3", {"host": "127.0.0.1", "port": port, "database": "d", "table": "t", "provideTs": True, "tsFieldName": "k", "fields": ["k", "v"], "sTable": "st", "tagFields": ["s"]})
        text = " ".join(body for _, body, _ in h.got)
        assert "t USING st TAGS ('a') (k,v) VALUES (1,1.5)" in text and "TAGS ('b c') (k,v) VALUES (2,NULL)" in text


def test_http_lookup(spark):
    answer = lambda path, body: None if path.endswith("9") else json.dumps({"w": path}).encode()
    with serving(h := Http(answer)) as port:
        got = services.http_lookup(spark.createDataFrame([(1,), (9,)], "k int"), "k", "w string", {"url": f"http://127.0.0.1:{port}/x/{{key}}"})
        assert sorted(map(tuple, got.collect()), key=str) == [(1, "/x/1"), (9, None)]
        assert len(h.got) == 2


def test_database_sink_and_lookup(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER, v TEXT)")
    how = {"module": "sqlite3", "connect": {"database": path, "timeout": 60}, "table": "t", "keyField": "id", "rowkindField": "kind"}
    first = spark.createDataFrame([(1, "a", "insert"), (2, "b", "upsert"), (3, "c", None), (9, "x", "update")], "id int, v string, kind string")
    sinks.write(first, "sql", how)
    sinks.write(spark.createDataFrame([(1, "A", "update"), (2, None, "delete"), (3, "C", "upsert"), (4, "d", "upsert")], first.schema), "sql", how)
    with sqlite3.connect(path) as c:
        assert sorted(c.execute("SELECT * FROM t").fetchall()) == [(1, "A"), (3, "C"), (4, "d")]
    sinks.write(first.select("id", "v").limit(1), "sql", {k: v for k, v in how.items() if k not in ("rowkindField", "keyField")})
    got = services.sql_lookup(spark.range(1, 4).withColumnRenamed("id", "n"), "n", "v string", {"module": "sqlite3", "connect": {"database": path}, "query": "SELECT v FROM t WHERE id = ?", "cache": True, "cacheTtl": 5})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A"), (1, "a"), (2, None), (3, "C")], key=str)


def test_batches_are_full(spark):
    df = spark.range(25).coalesce(1).selectExpr("id", "struct(id AS a) AS s")
    got = [r.rows for r in sinks.transformed(df, {"sendSingle": False, "batchSize": 10}).collect()]
    assert [len(x) for x in got] == [10, 10, 5] and got[2][4].s.a == 24
    assert [len(r.rows) for r in sinks.transformed(df, {"sendSingle": False}).collect()] == [25]
