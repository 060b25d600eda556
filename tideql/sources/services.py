"""Connectors of message and data services over plain sockets and HTTP: Redis, MQTT, InfluxDB, TDengine, databases.

Sinks send from the tasks that have the rows, a connection a task.  Sources of messages are Structured
Streaming sources: the driver's planner only names a span of time, and one task for each topic listens
in it; what a broker doesn't keep for a client that is away is lost, as it is for any subscriber.
"""

from __future__ import annotations

import importlib
import json
import socket
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import closing
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class ServiceProblem(RuntimeError):
    """The service refused, or left."""


def _address(text: str, port: int) -> tuple[str, int]:
    url = urlparse(text if "//" in text else f"//{text}")
    return url.hostname or "127.0.0.1", url.port or port


class Redis:
    """One connection that speaks RESP."""

    def __init__(self, addr: str, password: str | None = None, db: int = 0, seconds: float = 10):
        self.socket = socket.create_connection(_address(addr, 6379), seconds)
        self.file = self.socket.makefile("rb")
        if password:
            self.call("AUTH", password)
        if db:
            self.call("SELECT", db)

    def send(self, *parts) -> None:
        raw = [p if isinstance(p, bytes) else str(p).encode() for p in parts]
        self.socket.sendall(b"*%d\r\n" % len(raw) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in raw))

    def read(self):
        line = self.file.readline()
        if not line:
            raise ServiceProblem("redis closed the connection")
        kind, rest = line[:1], line[1:-2]
        if kind == b"-":
            raise ServiceProblem(rest.decode())
        if kind == b"+":
            return rest
        if kind == b":":
            return int(rest)
        if int(rest) < 0:
            return None
        if kind == b"$":
            return self.file.read(int(rest) + 2)[:-2]
        return [self.read() for _ in range(int(rest))]

    def call(self, *parts):
        self.send(*parts)
        return self.read()

    def close(self) -> None:
        self.file.close()
        self.socket.close()


class Mqtt:
    """One connection that speaks MQTT 3.1.1, with QoS 0 and 1."""

    def __init__(self, server: str, client: str | None = None, username: str | None = None, password: str | None = None, seconds: float = 10):
        self.socket, self.id = socket.create_connection(_address(server, 1883), seconds), 0
        text = self._text
        flags = 2 | (0x80 if username else 0) | (0x40 if password else 0)
        self._packet(0x10, text("MQTT") + bytes([4, flags]) + struct.pack(">H", 60) + text(client or uuid.uuid4().hex) + (text(username) if username else b"") + (text(password) if password else b""))
        kind, body = self._read()
        if kind >> 4 != 2 or body[1]:
            raise ServiceProblem(f"mqtt refused the connection: {body[1] if len(body) > 1 else kind}")

    @staticmethod
    def _text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">H", len(raw)) + raw

    def _packet(self, kind: int, body: bytes) -> None:
        size, n = b"", len(body)
        while True:
            n, low = n >> 7, n & 0x7F
            size += bytes([low | (0x80 if n else 0)])
            if not n:
                break
        self.socket.sendall(bytes([kind]) + size + body)

    def _exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            some = self.socket.recv(n - len(out))
            if not some:
                raise ServiceProblem("mqtt closed the connection")
            out += some
        return out

    def _read(self) -> tuple[int, bytes]:
        kind, n, shift = self._exactly(1)[0], 0, 0
        while True:
            b = self._exactly(1)[0]
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return kind, self._exactly(n)

    def _next(self) -> int:
        self.id = self.id % 65535 + 1
        return self.id

    def publish(self, topic: str, payload: bytes, qos: int = 0, retained: bool = False) -> None:
        qos = min(int(qos), 1)
        self._packet(0x30 | qos << 1 | bool(retained), self._text(topic) + (struct.pack(">H", self._next()) if qos else b"") + payload)
        while qos and self._read()[0] >> 4 != 4:
            pass

    def subscribe(self, topic: str, qos: int = 0) -> None:
        self._packet(0x82, struct.pack(">H", self._next()) + self._text(topic) + bytes([min(int(qos), 1)]))
        while self._read()[0] >> 4 != 9:
            pass

    def messages(self, until: float) -> Iterator[tuple[str, bytes]]:
        """What arrives up to a time."""
        while (left := until - time.time()) > 0:
            self.socket.settimeout(left)
            try:
                kind, body = self._read()
            except TimeoutError:
                return
            if kind >> 4 == 3:
                n = struct.unpack(">H", body[:2])[0]
                topic, rest = body[2 : 2 + n].decode(), body[2 + n :]
                if kind & 6:
                    self._packet(0x40, rest[:2])
                    rest = rest[2:]
                yield topic, rest

    def close(self) -> None:
        try:
            self._packet(0xE0, b"")
        finally:
            self.socket.close()


# --- sinks

def each_task(df: DataFrame, connect: Callable, put: Callable) -> None:
    """Every task with rows opens ``connect()`` and calls ``put(connection, batch)`` for each batch of them."""

    def send(batches):
        open_ = None
        try:
            for batch in batches:
                if len(batch):
                    open_ = open_ or connect()
                    put(open_, batch)
                yield pd.DataFrame({"n": [len(batch)]})
        finally:
            if open_ is not None and hasattr(open_, "close"):
                open_.close()

    df.mapInPandas(send, "n bigint").write.format("noop").mode("overwrite").save()


def _values(df: DataFrame, options: dict, *more) -> DataFrame:
    from .sinks import encoded

    names = [c for c in df.columns if not c.startswith("_s_")]
    if not more:
        return encoded(df.select(*names), {k: v for k, v in options.items() if k in ("sendNil", "format", "delimiter", "compression")})
    rest = df.select(F.to_json(F.struct(*names), {"ignoreNullFields": str(not options.get("sendNil", False)).lower()}).alias("value"), *more)
    return rest


def mqtt(df: DataFrame, options: dict) -> None:
    server, topic = options["server"], options["topic"]

    def put(client, batch):
        for value in batch["value"]:
            client.publish(topic, value if isinstance(value, bytes) else value.encode(), options.get("qos", 0), options.get("retained", False))

    each_task(_values(df, options), lambda: Mqtt(server, None, options.get("username"), options.get("password")), put)


def redis(df: DataFrame, options: dict) -> None:
    """SET, or LPUSH with dataType list, under ``key`` or the value of ``field``; keyType multiple writes each column under its name.  rowkindField: delete rows delete."""
    addr, kind = options["addr"], options.get("rowkindField")
    key = F.col(options["field"]).cast("string") if options.get("field") else F.lit(options.get("key"))
    rows = df.drop(kind) if kind else df
    out = df.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": str(not options.get("sendNil", False)).lower()}).alias("value"), key.alias("key"), (F.col(kind) if kind else F.lit("upsert")).alias("kind"))
    listed, seconds = options.get("dataType", "string") == "list", int(options.get("expiration", -1))

    def put(client, batch):
        for value, k, what in zip(batch["value"], batch["key"], batch["kind"], strict=True):
            pairs = json.loads(value).items() if options.get("keyType") == "multiple" else [(k, value)]
            for name, v in pairs:
                if what == "delete":
                    client.call(*(("LPOP", name) if listed else ("DEL", name)))
                    continue
                client.call("LPUSH" if listed else "SET", name, v if isinstance(v, str) else json.dumps(v))
                if seconds > 0:
                    client.call("EXPIRE", name, seconds)

    each_task(out, lambda: Redis(addr, options.get("password"), options.get("db", 0)), put)


def redis_pub(df: DataFrame, options: dict) -> None:
    address, channel = options["address"], options["channel"]

    def put(client, batch):
        for value in batch["value"]:
            client.call("PUBLISH", channel, value)

    each_task(_values(df, options), lambda: Redis(address, options.get("password"), options.get("db", 0)), put)


def _post(url: str, body: bytes, headers: dict) -> bytes:
    import urllib.request

    with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=10) as answer:  # noqa: S310
        return answer.read()


def line_protocol(df: DataFrame, options: dict) -> DataFrame:
    """Points in InfluxDB's text form: measurement, tags, fields, time; null fields are left out, rows without a field too."""
    from .sinks import template

    esc = lambda c: F.regexp_replace(c.cast("string"), "([,= ])", r"\\$1")
    when = options.get("tsFieldName")
    names = options.get("fields") or [c for c in df.columns if c != when]
    tags = [F.concat(F.lit(f",{k}="), esc(template(df, v))) for k, v in sorted(options.get("tags", {}).items())]

    def one(name: str):
        kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
        text = c.cast("string") if kind in ("double", "float", "boolean") or kind.startswith("decimal") else F.concat(c.cast("string"), F.lit("i")) if kind in ("long", "integer", "short", "byte") else F.concat(F.lit('"'), F.regexp_replace((F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string")), '(["\\\\])', r"\\$1"), F.lit('"'))
        return F.concat(F.lit(f"{name}="), text)

    fields = F.concat_ws(",", *map(one, names))
    stamp = [F.concat(F.lit(" "), F.col(when).cast("bigint").cast("string"))] if when else []
    return df.select(F.concat(F.lit(options["measurement"]), *tags, F.lit(" "), fields, *stamp).alias("value"), (fields != "").alias("some")).filter("some").select("value")


def influx(df: DataFrame, options: dict, version: int) -> None:
    from urllib.parse import quote, urlencode

    precision = options.get("precision", "ms")
    if version == 2:
        url = f"{options['addr']}/api/v2/write?{urlencode({'org': options.get('org', ''), 'bucket': options.get('bucket', ''), 'precision': precision})}"
        headers = {"Authorization": f"Token {options.get('token', '')}"}
    else:
        auth = {"u": options["username"], "p": options.get("password", "")} if options.get("username") else {}
        url, headers = f"{options['addr']}/write?{urlencode({'db': options['database'], 'precision': {'us': 'u', 'ns': 'n'}.get(precision, precision)} | auth, quote_via=quote)}", {}
    lines = df.select(F.col("value").cast("string").alias("value")) if options.get("useLineProtocol") else line_protocol(df, options)
    each_task(lines, lambda: url, lambda to, batch: _post(to, "\n".join(batch["value"]).encode(), headers))


def tdengine(df: DataFrame, options: dict) -> None:
    """INSERT over TDengine's HTTP interface, a statement a batch; with ``sTable`` into a table of its own tags."""
    import base64

    names = list(options.get("fields") or [c for c in df.columns if c not in options.get("tagFields", [])])
    when = options.get("tsFieldName", "ts")
    if not options.get("provideTs", False):
        df, names = df.withColumn("ts", F.unix_millis(F.current_timestamp())), ["ts", *(n for n in names if n != "ts")]
    else:
        names = [when, *(n for n in names if n != when)]
    text = lambda n: F.coalesce(F.concat(F.lit("'"), F.replace(F.col(n).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'")) if df.schema[n].dataType.typeName() == "string" else F.col(n).cast("string"), F.lit("NULL"))
    tags = F.concat(F.lit(f" USING {options['sTable']} TAGS ("), F.concat_ws(",", *map(text, options["tagFields"])), F.lit(")")) if options.get("sTable") else F.lit("")
    into = F.concat(F.lit(f"{options['table']}"), tags, F.lit(f" ({','.join(names)}) VALUES ("), F.concat_ws(",", *map(text, names)), F.lit(")"))
    url = f"http://{options.get('host', 'localhost')}:{options.get('port', 6041)}/rest/sql/{options['database']}"
    headers = {"Authorization": "Basic " + base64.b64encode(f"{options.get('user', 'root')}:{options.get('password', 'taosdata')}".encode()).decode()}

    def put(to, batch):
        answer = json.loads(_post(to, ("INSERT INTO " + " ".join(batch["value"])).encode(), headers) or b"{}")
        if answer.get("code"):
            raise ServiceProblem(str(answer.get("desc", answer)))

    each_task(df.select(into.alias("value")), lambda: url, put)


def database(df: DataFrame, options: dict) -> None:
    """Rows by their ``rowkindField`` (insert, update, upsert, delete) into a table, through a Python DB-API module.

    ``module`` and ``connect`` (its arguments) name the database; rows with one ``keyField`` go through one task, in
    the order of ``_ts`` where there is one, so that the last of them wins.  A task's rows are one transaction.
    """
    kind, key, table = options.get("rowkindField"), options.get("keyField"), options["table"]
    order = [c for c in ("_ts", "_o") if c in df.columns]
    names = list(options.get("fields") or [c for c in df.columns if c != kind and not c.startswith("_")])
    rows = df.select(*names, *order, (F.coalesce(F.col(kind), F.lit("upsert")) if kind else F.lit("insert")).alias("_kind"))
    if kind:
        rows = rows.repartition(key).sortWithinPartitions(key, *order)
    mark = {"qmark": "?", "format": "%s", "pyformat": "%s", "numeric": "?"}[importlib.import_module(options["module"]).paramstyle]
    insert = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join([mark] * len(names))})"
    update = f"UPDATE {table} SET {', '.join(f'{n} = {mark}' for n in names if n != key)} WHERE {key} = {mark}"

    def put(connection, batch):
        cursor = connection.cursor()
        plain = batch.astype(object).where(batch.notna(), None)
        for row in plain.to_dict("records"):
            every, what = [row[n] for n in names], row["_kind"]
            if what == "delete":
                cursor.execute(f"DELETE FROM {table} WHERE {key} = {mark}", [row[key]])  # noqa: S608
                continue
            if what in ("update", "upsert"):
                cursor.execute(update, [*(row[n] for n in names if n != key), row[key]])
                if what == "update" or cursor.rowcount > 0:
                    continue
            cursor.execute(insert, every)
        connection.commit()

    def connect():
        return importlib.import_module(options["module"]).connect(**options.get("connect", {}))

    each_task(rows, connect, put)


def kafka(df: DataFrame, options: dict) -> None:
    rows = _values(df, options).withColumn("key", F.lit(options.get("key")).cast("string"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", options["brokers"]).option("topic", options["topic"]).save()


# --- lookups

_FETCHED: dict[tuple, tuple[float, object]] = {}


def cached(key: tuple, seconds: float, missing: bool, fetch: Callable):
    """A worker's memory of what it looked up, for ``seconds``; of nothing found too, if ``missing``."""
    now, known = time.monotonic(), _FETCHED.get(key)
    if known is not None and now - known[0] < seconds:
        return known[1]
    found = fetch()
    if seconds > 0 and (missing or found is not None):
        if len(_FETCHED) > 100_000:
            _FETCHED.clear()
        _FETCHED[key] = (now, found)
    return found


def probe(df: DataFrame, key: str, schema: str, connect: Callable, fetch: Callable, name: str, ttl: float = 0, missing: bool = False) -> DataFrame:
    """``df`` left-joined with an outer lookup: ``fetch(connection, key)`` gives a JSON object, an array of them, or None.

    Only keys that rows have are asked for, each once a batch, and remembered for ``ttl`` seconds.
    """

    def ask(batches):
        open_ = None
        try:
            for batch in batches:
                keys, answers = batch.column(batch.schema.get_field_index(key)).to_pylist(), {}
                for k in {k for k in keys if k is not None}:
                    def get(k=k):
                        nonlocal open_
                        open_ = open_ or connect()
                        return fetch(open_, k)

                    answers[k] = cached((name, k), ttl, missing, get)
                text = [answers.get(k) for k in keys]
                found = pa.array([t if t is None or t.lstrip().startswith("[") else f"[{t}]" for t in text], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_found"])
        finally:
            if open_ is not None and hasattr(open_, "close"):
                open_.close()

    out = df.mapInArrow(ask, T.StructType([*df.schema.fields, T.StructField("_found", T.StringType())]))
    out = out.withColumn("_x", F.explode_outer(F.from_json("_found", f"array<struct<{schema}>>")))
    return out.select(*df.columns, "_x.*")


def redis_lookup(df: DataFrame, key: str, schema: str, options: dict) -> DataFrame:
    """The JSON under each key of a Redis."""
    listed = options.get("dataType", "string") == "list"

    def fetch(client, k):
        found = client.call("LRANGE", k, 0, -1) if listed else client.call("GET", k)
        if listed:
            return "[" + ",".join(x.decode() for x in found) + "]" if found else None
        return None if found is None else found.decode()

    return probe(df, key, schema, lambda: Redis(options["addr"], options.get("password"), options.get("db", 0)), fetch, f"redis {options['addr']}", options.get("cacheTtl", 0) if options.get("cache") else 0, options.get("cacheMissingKey", False))


def http_lookup(df: DataFrame, key: str, schema: str, options: dict) -> DataFrame:
    """What ``url`` answers, with ``{key}`` in it replaced by the row's."""
    from urllib.error import HTTPError
    from urllib.parse import quote
    from urllib.request import urlopen

    def fetch(_, k):
        try:
            with urlopen(options["url"].replace("{key}", quote(str(k))), timeout=options.get("timeout", 5)) as answer:  # noqa: S310
                return answer.read().decode() or None
        except HTTPError as e:
            if e.code == 404:
                return None
            raise

    return probe(df, key, schema, lambda: True, fetch, f"http {options['url']}", options.get("cacheTtl", 0) if options.get("cache") else 0, options.get("cacheMissingKey", False))


def sql_lookup(df: DataFrame, key: str, schema: str, options: dict) -> DataFrame:
    """The rows that ``query``, with one parameter, gives for each key, through a Python DB-API module."""

    def fetch(connection, k):
        cursor = connection.cursor()
        cursor.execute(options["query"], [k])
        names = [d[0] for d in cursor.description]
        rows = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
        return json.dumps(rows, default=str) if rows else None

    return probe(df, key, schema, lambda: importlib.import_module(options["module"]).connect(**options.get("connect", {})), fetch, f"sql {options['query']}", options.get("cacheTtl", 0) if options.get("cache") else 0, options.get("cacheMissingKey", False))


# --- sources of messages

class _Topic(InputPartition):
    def __init__(self, topic: str):
        self.topic = topic


def _listen(options: dict, topic: str, seconds: float) -> Iterator[tuple]:
    """(topic, payload, time) of what arrives within ``seconds``."""
    until = time.time() + seconds
    if options["kind"] == "mqtt":
        # A client of a fixed name with a lasting session has what came while it was away.
        with closing(Mqtt(options["server"], options.get("clientid"), options.get("username"), options.get("password"))) as client:
            client.subscribe(topic, int(options.get("qos", 0)))
            for t, raw in client.messages(until):
                yield t, raw, time.time()
        return
    with closing(Redis(options["server"], options.get("password"), int(options.get("db", 0)))) as client:
        client.call("PSUBSCRIBE" if "*" in topic else "SUBSCRIBE", topic)
        while (left := until - time.time()) > 0:
            client.socket.settimeout(left)
            try:
                found = client.read()
            except (TimeoutError, OSError):
                return
            if found[0] in (b"message", b"pmessage"):
                yield found[-2].decode(), found[-1], time.time()


class _Bounded(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Topic(t.strip()) for t in self.options["topics"].split(",")]

    def read(self, partition):
        for t, raw, at in _listen(self.options, partition.topic, float(self.options.get("seconds", 5))):
            yield Row(topic=t, payload=raw, time=int(at * 1000))


class _Endless(SimpleDataSourceStreamReader):
    """A micro-batch is what came within ``seconds``; it is kept until it is committed, so that it can be read again."""

    def __init__(self, options: dict):
        self.options, self.held = options, {}

    def initialOffset(self):  # noqa: N802
        return {"n": 0}

    def read(self, start):
        rows = [(t, raw, int(at * 1000)) for topic in self.options["topics"].split(",") for t, raw, at in _listen(self.options, topic.strip(), float(self.options.get("seconds", 1)))]
        if not rows:
            return iter([]), start
        end = {"n": start["n"] + len(rows)}
        self.held[start["n"], end["n"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start, end):  # noqa: N802
        return iter(self.held.get((start["n"], end["n"]), []))

    def commit(self, end):
        self.held = {k: v for k, v in self.held.items() if k[1] > end["n"]}


class Messages(DataSource):
    """``spark.read`` and ``readStream`` format "tideql_messages": options kind (mqtt, redis), server, topics, seconds."""

    @classmethod
    def name(cls) -> str:
        return "tideql_messages"

    def schema(self) -> str:
        return "topic string, payload binary, time bigint"

    def reader(self, schema):
        return _Bounded(dict(self.options))

    def simpleStreamReader(self, schema):  # noqa: N802
        return _Endless(dict(self.options))


def messages(spark, kind: str, server: str, topics: str, options: dict, streaming: bool) -> DataFrame:
    spark.dataSource.register(Messages)
    reader = (spark.readStream if streaming else spark.read).format("tideql_messages").option("kind", kind).option("server", server).option("topics", topics)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
